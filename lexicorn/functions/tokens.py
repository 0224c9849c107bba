"""Token-array Column functions (pure Spark SQL higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published byte-level pre-split pattern, minus its lookahead
# whitespace branch (after cleaning every space precedes a non-space, so it never
# fires); the same text is valid in Java regex and RE2.
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

# Reserved ids.
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
N_RESERVED = 3
# After them one id for each byte value, for characters that the vocabulary lacks.
N_BYTES = 256
FIRST_LEARNED = N_RESERVED + N_BYTES
PAD_TOKEN, EOS_TOKEN, UNK_TOKEN = "<pad>", "<eos>", "<unk>"
IGNORE_LABEL = -100
MAX_GEN_LEN = 20


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def pretokenize(c: Column | str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(PRETOKEN_PATTERN), 0)


def cut_at(ids: Column | str, token_id: int | Column) -> Column:
    """Prefix before the first occurrence of ``token_id`` (whole array if absent)."""
    a = _c(ids)
    tid = token_id if isinstance(token_id, Column) else F.lit(token_id)
    pos = F.array_position(a, tid)
    return F.when(pos > 0, F.slice(a, F.lit(1), (pos - 1).cast("int"))).otherwise(a)


def cut_at_pad_then_eos(ids: Column | str, eos_id: int = EOS_ID) -> Column:
    return cut_at(cut_at(ids, PAD_ID), eos_id)


def token_split_point(ids: Column | str, fraction: float = 0.5) -> Column:
    return F.floor(F.size(_c(ids)) * F.lit(float(fraction))).cast("int")


def token_prompt(ids: Column | str, fraction: float = 0.5) -> Column:
    a = _c(ids)
    return F.slice(a, F.lit(1), token_split_point(a, fraction))


def token_reference(ids: Column | str, fraction: float = 0.5) -> Column:
    a = _c(ids)
    n = token_split_point(a, fraction)
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def truncate(ids: Column | str, max_length: int) -> Column:
    return F.slice(_c(ids), 1, int(max_length))


def attention_mask(ids: Column | str) -> Column:
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def ids_text(ids: Column | str) -> Column:
    """Space-joined rendering of an id array (stable for hashing / comparison)."""
    return F.array_join(_c(ids), " ")


# ROUGE tokenisation: lower-case, runs outside [a-z0-9] become spaces, split, drop empties.
def rouge_tokens(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(s), " "), lambda x: x != "")
