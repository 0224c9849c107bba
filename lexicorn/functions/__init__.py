from lexicorn.functions.text import clean_text, char_prompt, char_reference, strip_prefix  # noqa: F401
from lexicorn.functions.hashing import hash_uniform  # noqa: F401
