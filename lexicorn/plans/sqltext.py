"""DuckDB twins of the Column functions, as SQL text fragments for the oracle queries."""

from __future__ import annotations

from lexicorn.functions.text import (
    HASHTAG_PATTERN, MENTION_PATTERN, SPACE_RUN_PATTERN, SYMBOL_OTHER_PATTERN, URL_PATTERN)
from lexicorn.sources.corpus import DECOR_TAG, DECOR_TAIL, DECOR_URL, NULL_MARKER, TURN_BITS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(expr: str) -> str:
    t = f"lower(coalesce({expr}, ''))"
    t = f"regexp_replace({t}, {q(URL_PATTERN)}, '', 'g')"
    t = f"regexp_replace({t}, {q(MENTION_PATTERN)}, '', 'g')"
    t = f"regexp_replace({t}, {q(HASHTAG_PATTERN)}, '\\1', 'g')"
    t = f"regexp_replace({t}, {q(SYMBOL_OTHER_PATTERN)}, '', 'g')"
    t = f"trim(regexp_replace({t}, {q(SPACE_RUN_PATTERN)}, ' ', 'g'))"
    return t


CONV = f"SELECT conv_id * {1 << TURN_BITS} + turn AS row_id, nullif(text, {q(NULL_MARKER)}) AS text FROM conversations"
DOCS = f"SELECT doc_id AS row_id, nullif(text, {q(NULL_MARKER)}) AS text FROM documents"


def decorated(expr_text: str = "text", expr_id: str = "row_id") -> str:
    rid = f"CAST({expr_id} AS VARCHAR)"
    return f"({expr_text} || {q(DECOR_URL)} || {rid} || {q(DECOR_TAG)} || {rid} || {q(DECOR_TAIL)})"


def char_cut(expr: str, fraction: float) -> str:
    return f"CAST(floor(length({expr}) * {float(fraction)!r}) AS INTEGER)"


# ------------------------------------------------------------------ pipeline twins
from lexicorn.functions.hashing import sql_hash_uniform  # noqa: E402
from lexicorn.functions.tokens import FIRST_LEARNED, N_BYTES, N_RESERVED, PRETOKEN_PATTERN  # noqa: E402
from lexicorn.operators.splits import thresholds  # noqa: E402
from lexicorn.operators.vocab import CHARACTER  # noqa: E402


def split_conv(cfg) -> str:
    t1, t2 = thresholds(cfg.train, cfg.val, cfg.test)
    u = sql_hash_uniform(cfg.seed, "row_id")
    return (f"SELECT row_id, {clean('text')} AS text, CASE WHEN {u} < {t1!r} THEN 'train' "
            f"WHEN {u} < {t2!r} THEN 'validation' ELSE 'test' END AS split FROM ({CONV})")


def pretok(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(PRETOKEN_PATTERN)}, 0)"


def characters(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(CHARACTER)}, 0)"


def docs_clean() -> str:
    return f"SELECT row_id, {clean('text')} AS text FROM ({DOCS})"


def vocab(cfg) -> str:
    return f"""(
  WITH vt AS (SELECT text FROM ({split_conv(cfg)}) WHERE split = 'train'
              UNION ALL SELECT text FROM ({docs_clean()})),
  vc AS (SELECT token, CAST(count(*) AS BIGINT) AS count
         FROM (SELECT unnest({pretok('text')}) AS token FROM vt) GROUP BY token),
  vch AS (SELECT c AS token, CAST(sum(count) AS BIGINT) AS count
          FROM (SELECT unnest({characters('token')}) AS c, count FROM vc) GROUP BY c
          ORDER BY count DESC, token LIMIT {cfg.vocab_size // 2}),
  vtop AS (SELECT * FROM (SELECT 0 AS part, token, count FROM vch
                          UNION ALL SELECT 1, token, count FROM vc WHERE length(token) > 1)
           ORDER BY part, count DESC, token LIMIT {cfg.vocab_size - FIRST_LEARNED})
  SELECT token, CAST(row_number() OVER (ORDER BY part, count DESC, token) + {FIRST_LEARNED - 1} AS INTEGER) AS id, count
  FROM vtop
  UNION ALL SELECT printf('<0x%02X>', k), CAST(k + {N_RESERVED} AS INTEGER), 0 FROM range({N_BYTES}) b(k)
  UNION ALL SELECT '<pad>', 0, 0 UNION ALL SELECT '<eos>', 1, 0 UNION ALL SELECT '<unk>', 2, 0)"""


def encode(rows_sql: str, cfg, extra_cols: str = "", vocab_sql: str | None = None,
           max_length: int | None | str = "cfg", append_eos: bool | None = None) -> str:
    """rows_sql has (row_id, text, <extra_cols>) -> (row_id, <extra>, ids INTEGER[]).

    ``max_length`` None means no truncation; the default takes the config's."""
    ml = cfg.max_length if max_length == "cfg" else max_length
    ae = cfg.append_eos if append_eos is None else append_eos
    vs = vocab_sql or vocab(cfg)
    ex = (", " + extra_cols) if extra_cols else ""
    spelled = (f"list_transform(generate_series(1, CAST(strlen(s.piece) AS BIGINT)), lambda i: "
               f"CAST('0x' || substr(hex(encode(s.piece)), 2 * i - 1, 2) AS INTEGER) + {N_RESERVED})")
    ids = (f"coalesce(flatten(list(CASE WHEN v.id IS NOT NULL THEN [CAST(v.id AS INTEGER)] ELSE {spelled} END "
           "ORDER BY s.pos, s.sub) FILTER (WHERE s.pos IS NOT NULL)), [])")
    body = f"list_slice({ids}, 1, {ml})" if ml is not None else ids
    if ae:
        ended = f"list_concat({body}, [CAST(1 AS INTEGER)])"
        body = ended if ml is None else f"CASE WHEN len({ids}) <= {ml} THEN {ended} ELSE {body} END"
    own = "".join(", er." + c.strip() for c in extra_cols.split(",")) if extra_cols else ""
    return f"""(
  WITH er AS (SELECT row_number() OVER () AS rn, row_id{ex}, {pretok('text')} AS toks FROM ({rows_sql})),
  et AS (SELECT rn, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM er),
  ev AS MATERIALIZED (SELECT token, id FROM {vs} WHERE id >= {FIRST_LEARNED}),
  ep AS (SELECT et.rn, et.pos, CASE WHEN v.id IS NULL THEN {characters('et.token')} ELSE [et.token] END AS pieces
         FROM et LEFT JOIN ev v ON v.token = et.token),
  es AS (SELECT rn, pos, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS sub FROM ep)
  SELECT er.row_id{own}, {body} AS ids
  FROM er LEFT JOIN es s ON s.rn = er.rn LEFT JOIN ev v ON v.token = s.piece
  GROUP BY er.rn, er.row_id{own})"""


def encoded_conv(cfg) -> str:
    return encode(split_conv(cfg), cfg, "split")


def ids_str(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


# ------------------------------------------------------------------ n-gram twins

def events(rows_sql: str, order: int, min_k: int = 1) -> str:
    """rows_sql has (row_id, ids) -> (row_id, j, k, ctx, w)."""
    return f"""(SELECT row_id, j, k, list_slice(ids, j - k + 1, j - 1) AS ctx, ids[j] AS w
  FROM (SELECT row_id, ids, unnest(generate_series(2, len(ids))) AS j FROM ({rows_sql})) ev0,
       range({int(min_k)}, {int(order) + 1}) r(k)
  WHERE k <= j)"""


def ngrams(rows_sql: str, order: int, min_count: int = 1) -> str:
    having = f" HAVING k = 1 OR count(*) >= {int(min_count)}" if min_count > 1 else ""
    return f"""(SELECT CAST(k AS INTEGER) AS k, ctx, w, CAST(count(*) AS BIGINT) AS c
  FROM {events(rows_sql, order)} GROUP BY k, ctx, w{having})"""


def contexts(ngrams_sql: str) -> str:
    return f"(SELECT k, ctx, CAST(sum(c) AS BIGINT) AS n FROM {ngrams_sql} GROUP BY k, ctx)"


def level_probs(eval_sql: str, ngrams_sql: str, order: int) -> str:
    """(row_id, j, w, p1..pN) -- same back-off fill as the Spark operator."""
    ctx_sql = contexts(ngrams_sql)
    n1 = f"(SELECT greatest(sum(c), 1) FROM {ngrams_sql} WHERE k = 1)"
    cols = ", ".join(
        f"max(CASE WHEN e.k = {k} THEN cx.n END) AS n{k}, max(CASE WHEN e.k = {k} THEN ng.c END) AS c{k}"
        for k in range(2, order + 1))
    if order >= 2:
        pos = f"""(SELECT e.row_id, e.j, first(e.w) AS w, {cols}
      FROM {events(eval_sql, order, 2)} e
      LEFT JOIN {ctx_sql} cx ON cx.k = e.k AND cx.ctx = e.ctx
      LEFT JOIN {ngrams_sql} ng ON ng.k = e.k AND ng.ctx = e.ctx AND ng.w = e.w
      GROUP BY e.row_id, e.j)"""
    else:
        pos = f"(SELECT row_id, j, w FROM {events(eval_sql, 1)})"
    p = f"(CAST(coalesce(u.c, 0) AS DOUBLE) / CAST({n1} AS DOUBLE))"
    exprs = [f"{p} AS p1"]
    for k in range(2, order + 1):
        p = f"(CASE WHEN pos.n{k} IS NOT NULL THEN CAST(coalesce(pos.c{k}, 0) AS DOUBLE) / pos.n{k} ELSE {p} END)"
        exprs.append(f"{p} AS p{k}")
    return f"""(SELECT pos.row_id, pos.j, pos.w, {', '.join(exprs)}
  FROM {pos} pos LEFT JOIN (SELECT w, c FROM {ngrams_sql} WHERE k = 1) u ON u.w = pos.w)"""


def mixture(lambdas, vocab_size: int, order: int) -> str:
    expr = f"{float(lambdas[0]) / float(vocab_size)!r}"
    for k in range(1, order + 1):
        expr = f"({expr} + {float(lambdas[k])!r} * p{k})"
    return expr


def ctx_str(expr: str = "ctx") -> str:
    return f"array_to_string({expr}, ' ')"


# ------------------------------------------------------------------ generation twins

def greedy_rounds(prompts_sql: str, ngrams_sql: str, order: int, lambdas, vocab_size: int,
                  rounds: int, eos_id: int = 1) -> str:
    """WITH-chain for greedy generation; prompts_sql has (seq_id, prompt_ids). Ends with g{rounds}.
    A weight is a number or a scalar SQL expression."""
    N = order

    def weight(x) -> str:
        return x if isinstance(x, str) else f"{float(x)!r}"
    floor = f"({lambdas[0]} / {float(vocab_size)!r})" if isinstance(lambdas[0], str) \
        else f"{float(lambdas[0]) / float(vocab_size)!r}"
    n1 = f"(SELECT CAST(greatest(sum(c), 1) AS DOUBLE) FROM ng WHERE k = 1)"
    top = "(SELECT w FROM ng WHERE k = 1 ORDER BY c DESC, w LIMIT 1)"
    parts = [f"ng AS MATERIALIZED (SELECT * FROM {ngrams_sql})",
             f"g0 AS (SELECT seq_id, prompt_ids, CASE WHEN len(prompt_ids) = 0 THEN [CAST({eos_id} AS INTEGER)] "
             f"ELSE prompt_ids END AS ids, 0 AS n_new, len(prompt_ids) = 0 AS done FROM ({prompts_sql}))"]
    for r in range(1, rounds + 1):
        p = f"(CAST(coalesce(u.c, 0) AS DOUBLE) / {n1})"
        score = f"({floor} + {weight(lambdas[1])} * {p})"
        for k in range(2, N + 1):
            p = f"(CASE WHEN t.n{k} IS NOT NULL THEN CAST(coalesce(wc.c{k}, 0) AS DOUBLE) / t.n{k} ELSE {p} END)"
            score = f"({score} + {weight(lambdas[k])} * {p})"
        tn = ", ".join(f"sum(CASE WHEN k = {k} THEN c END) AS n{k}" for k in range(2, N + 1))
        wcs = ", ".join(f"max(CASE WHEN k = {k} THEN c END) AS c{k}" for k in range(2, N + 1))
        parts.append(f"""a{r} AS (SELECT seq_id, ids, list_slice(ids, greatest(len(ids) - {N - 1} + 1, 1), len(ids)) AS ck
      FROM g{r - 1} WHERE NOT done),
d{r} AS (SELECT DISTINCT ck FROM a{r}),
l{r} AS (SELECT ck, k, list_slice(ck, len(ck) - k + 2, len(ck)) AS hk FROM d{r}, range(2, {N + 1}) rr(k)
      WHERE len(ck) >= k - 1),
c{r} AS (SELECT l.ck, l.k, ng.w, ng.c FROM l{r} l JOIN ng ON ng.k = l.k AND ng.ctx = l.hk),
t{r} AS (SELECT ck, {tn} FROM c{r} GROUP BY ck),
w{r} AS (SELECT ck, w, {wcs} FROM (SELECT ck, k, w, c FROM c{r}
      UNION ALL SELECT ck, 0, {top}, NULL FROM d{r}) GROUP BY ck, w),
s{r} AS (SELECT wc.ck, wc.w, {score} AS score FROM w{r} wc LEFT JOIN t{r} t ON t.ck = wc.ck
      LEFT JOIN (SELECT w, c FROM ng WHERE k = 1) u ON u.w = wc.w),
b{r} AS (SELECT ck, w FROM (SELECT ck, w, row_number() OVER (PARTITION BY ck ORDER BY score DESC, w) AS rn
      FROM s{r}) WHERE rn = 1),
g{r} AS (SELECT g.seq_id, g.prompt_ids,
      CASE WHEN g.done THEN g.ids ELSE list_append(g.ids, b.w) END AS ids,
      CASE WHEN g.done THEN g.n_new ELSE g.n_new + 1 END AS n_new,
      g.done OR b.w = {eos_id} OR g.n_new + 1 >= {rounds} AS done
      FROM g{r - 1} g LEFT JOIN a{r} a ON a.seq_id = g.seq_id LEFT JOIN b{r} b ON b.ck = a.ck)""")
    return "WITH " + ",\n".join(parts)


def sampled_rounds(prompts_sql: str, ngrams_sql: str, order: int, lambdas, vocab_size: int, rounds: int,
                   temperature: float, top_p: float, seed: int, eos_id: int = 1) -> str:
    """WITH-chain for sampled generation over the whole vocabulary, one distribution per distinct
    context; prompts_sql has (seq_id, prompt_ids). Ends with g{rounds}."""
    N, t_inv = order, 1.0 / max(temperature, 1e-8)
    parts = [f"ng AS MATERIALIZED (SELECT * FROM {ngrams_sql})",
             "n1 AS MATERIALIZED (SELECT CAST(greatest(sum(c), 1) AS DOUBLE) AS n FROM ng WHERE k = 1)",
             f"""vv AS MATERIALIZED (SELECT r.w, CAST(coalesce(u.c, 0) AS DOUBLE) / (SELECT n FROM n1) AS p1
  FROM range(0, {vocab_size}) r(w) LEFT JOIN (SELECT w, c FROM ng WHERE k = 1) u ON u.w = r.w)""",
             f"g0 AS (SELECT seq_id, prompt_ids, CASE WHEN len(prompt_ids) = 0 THEN [CAST({eos_id} AS INTEGER)] "
             f"ELSE prompt_ids END AS ids, 0 AS n_new, len(prompt_ids) = 0 AS done FROM ({prompts_sql}))"]
    for r in range(1, rounds + 1):
        p, score = "v.p1", f"({float(lambdas[0]) / float(vocab_size)!r} + {float(lambdas[1])!r} * v.p1)"
        for k in range(2, N + 1):
            p = f"(CASE WHEN t.n{k} IS NOT NULL THEN CAST(coalesce(wc.c{k}, 0) AS DOUBLE) / t.n{k} ELSE {p} END)"
            score = f"({score} + {float(lambdas[k])!r} * {p})"
        tn = ", ".join(f"sum(CASE WHEN k = {k} THEN c END) AS n{k}" for k in range(2, N + 1))
        wcs = ", ".join(f"max(CASE WHEN k = {k} THEN c END) AS c{k}" for k in range(2, N + 1))
        by_p = "PARTITION BY ck ORDER BY q DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        parts.append(f"""a{r} AS (SELECT seq_id, ids, list_slice(ids, greatest(len(ids) - {N - 1} + 1, 1), len(ids)) AS ck,
      {sql_hash_uniform(seed, 'seq_id', f"'{r}'")} AS u FROM g{r - 1} WHERE NOT done),
d{r} AS (SELECT DISTINCT ck FROM a{r}),
l{r} AS (SELECT ck, k, list_slice(ck, len(ck) - k + 2, len(ck)) AS hk FROM d{r}, range(2, {N + 1}) rr(k)
      WHERE len(ck) >= k - 1),
c{r} AS (SELECT l.ck, l.k, ng.w, ng.c FROM l{r} l JOIN ng ON ng.k = l.k AND ng.ctx = l.hk),
t{r} AS (SELECT ck, {tn} FROM c{r} GROUP BY ck),
w{r} AS (SELECT ck, w, {wcs} FROM c{r} GROUP BY ck, w),
s{r} AS (SELECT d.ck, v.w, {score} AS p FROM d{r} d CROSS JOIN vv v LEFT JOIN t{r} t ON t.ck = d.ck
      LEFT JOIN w{r} wc ON wc.ck = d.ck AND wc.w = v.w),
q{r} AS (SELECT ck, w, pow(p / max(p) OVER (PARTITION BY ck), {t_inv!r}) AS q FROM s{r}),
k{r} AS (SELECT ck, w, q, rn FROM (SELECT ck, w, q, round(sum(q) OVER ({by_p}) / sum(q) OVER (PARTITION BY ck), 12) AS cum,
      row_number() OVER (PARTITION BY ck ORDER BY q DESC, w) AS rn FROM q{r}) WHERE cum <= {float(top_p)!r} OR rn = 1),
f{r} AS MATERIALIZED (SELECT ck, w, rn, round(sum(q) OVER ({by_p}) / sum(q) OVER (PARTITION BY ck), 12) AS cdf,
      max(rn) OVER (PARTITION BY ck) AS last FROM k{r}),
b{r} AS (SELECT a.seq_id, arg_min(f.w, f.rn) AS w FROM a{r} a JOIN f{r} f ON f.ck = a.ck
      WHERE f.cdf > a.u OR f.rn = f.last GROUP BY a.seq_id),
g{r} AS MATERIALIZED (SELECT g.seq_id, g.prompt_ids,
      CASE WHEN g.done THEN g.ids ELSE list_append(g.ids, CAST(b.w AS INTEGER)) END AS ids,
      CASE WHEN g.done THEN g.n_new ELSE g.n_new + 1 END AS n_new,
      g.done OR b.w = {eos_id} OR g.n_new + 1 >= {rounds} AS done
      FROM g{r - 1} g LEFT JOIN b{r} b ON b.seq_id = g.seq_id)""")
    return "WITH " + ",\n".join(parts)


def continuation(gen: str = "ids", prompt: str = "prompt_ids") -> str:
    return f"list_slice({gen}, len({prompt}) + 1, len({gen}))"


def cut_eos(expr: str, eos_id: int = 1) -> str:
    return (f"(CASE WHEN list_position({expr}, {eos_id}) > 0 THEN "
            f"list_slice({expr}, 1, list_position({expr}, {eos_id}) - 1) ELSE {expr} END)")


def decode(rows_sql: str, ids_expr: str, vocab_sql: str, out: str) -> str:
    """rows_sql has row_id; returns (row_id, out) with reserved ids skipped and runs of byte ids
    joined, a run that is no UTF-8 as U+FFFD."""
    return f"""(WITH dw AS MATERIALIZED (SELECT x.row_id, {ids_expr} AS seq FROM ({rows_sql}) x),
  dx AS MATERIALIZED (SELECT dw.row_id, u.id, u.pos, u.id < {FIRST_LEARNED} AS b
      FROM dw, unnest(dw.seq) WITH ORDINALITY AS u(id, pos) WHERE u.id >= {N_RESERVED}),
  dr AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos)
      - row_number() OVER (PARTITION BY row_id, b ORDER BY pos) AS run FROM dx),
  dp AS (SELECT dr.row_id, dr.pos, v.token AS piece FROM dr JOIN {vocab_sql} v ON v.id = dr.id WHERE NOT dr.b
    UNION ALL SELECT row_id, pos, coalesce(TRY(decode(unhex(hexes))), chr(65533)) FROM (SELECT row_id, min(pos) AS pos,
      string_agg(printf('%02X', CAST(id - {N_RESERVED} AS INTEGER)), '' ORDER BY pos) AS hexes FROM dr WHERE b GROUP BY row_id, run))
  SELECT y.row_id, coalesce(z.said, '') AS {out} FROM (SELECT DISTINCT row_id FROM dw) y
  LEFT JOIN (SELECT row_id, string_agg(piece, '' ORDER BY pos) AS said FROM dp GROUP BY row_id) z ON z.row_id = y.row_id)"""


def rouge_tok(expr: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(lower({expr}), '[^a-z0-9]+', ' ', 'g')), ' '),"
            f" lambda x: x <> '')")


def lcs(a: str, b: str) -> str:
    inner = (f"list_reduce(generate_series(1, len({b})), lambda cur, j: list_append(cur, CASE WHEN x = {b}[j] "
             f"THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0])")
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE "
            f"list_reduce({a}, lambda prev, x: {inner}, list_transform(generate_series(0, len({b})), lambda y: 0))[-1] END)")


def f1(lcs_expr: str, n_ref: str, n_hyp: str) -> str:
    p = f"(CAST({lcs_expr} AS DOUBLE) / {n_hyp})"
    r = f"(CAST({lcs_expr} AS DOUBLE) / {n_ref})"
    return (f"(CASE WHEN {n_ref} = 0 OR {n_hyp} = 0 THEN 0.0 WHEN {p} + {r} > 0 "
            f"THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)")


# ------------------------------------------------------------------ subword twins

def bpe_rounds(texts_sql: str, n: int) -> str:
    """WITH-chain of merge learning: bw{r} the words and bt{r} the top pair of round r."""
    parts = [f"""bw0 AS MATERIALIZED (SELECT word, count(*) AS freq,
  regexp_replace(word, {q(CHARACTER)}, chr(2) || '\\0' || chr(3), 'g') AS spelled
  FROM (SELECT unnest({pretok('text')}) AS word FROM ({texts_sql})) GROUP BY word)"""]
    for r in range(1, n + 1):
        parts.append(f"""bs{r} AS (SELECT freq, string_split(spelled[2:-2], chr(3) || chr(2)) AS s FROM bw{r - 1}),
bt{r} AS MATERIALIZED (SELECT a, b, CAST(sum(freq) AS BIGINT) AS count FROM
  (SELECT freq, unnest(s[:-2]) AS a, unnest(s[2:]) AS b FROM bs{r} WHERE len(s) > 1)
  GROUP BY a, b ORDER BY count DESC, a, b LIMIT 1),
bw{r} AS MATERIALIZED (SELECT word, freq, replace(spelled, chr(2) || a || chr(3) || chr(2) || b || chr(3),
  chr(2) || a || b || chr(3)) AS spelled FROM bw{r - 1}, bt{r})""")
    return "WITH " + ",\n".join(parts)


def bpe_merges(n: int) -> str:
    return " UNION ALL ".join(f"SELECT {r} AS rank, a, b, count FROM bt{r}" for r in range(1, n + 1))


def bpe_applied(rows_sql: str, n: int) -> str:
    """CTEs after `bpe_rounds` -> applied(row_id, subwords); rows_sql has (row_id, text)."""
    parts = [f"ar AS (SELECT row_id, {pretok('text')} AS words FROM ({rows_sql}))",
             f"""ad0 AS MATERIALIZED (SELECT word, regexp_replace(word, {q(CHARACTER)}, chr(2) || '\\0' || chr(3), 'g')
  AS spelled FROM (SELECT DISTINCT unnest(words) AS word FROM ar))"""]
    for r in range(1, n + 1):
        parts.append(f"""ad{r} AS (SELECT word, replace(spelled, chr(2) || a || chr(3) || chr(2) || b || chr(3),
  chr(2) || a || b || chr(3)) AS spelled FROM ad{r - 1}, bt{r})""")
    parts.append(f"""aw AS (SELECT row_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM ar),
applied AS (SELECT ar.row_id, coalesce(flatten(list(string_split(d.spelled[2:-2], chr(3) || chr(2)) ORDER BY aw.pos)
  FILTER (WHERE aw.pos IS NOT NULL)), []) AS subwords
  FROM ar LEFT JOIN aw ON aw.row_id = ar.row_id LEFT JOIN ad{n} d ON d.word = aw.word GROUP BY ar.row_id)""")
    return ",\n".join(parts)
