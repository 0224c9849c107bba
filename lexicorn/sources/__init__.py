from lexicorn.sources.corpus import (  # noqa: F401
    table, conversations, documents, benchmark, decorated, first_rows, csv_corpus, turn_key)
