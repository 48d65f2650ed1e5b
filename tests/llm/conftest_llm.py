"""What the tests of this folder share beside fixtures."""

from __future__ import annotations

#: Null, empty, blank, very long, repeated rows, and a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 60_000), (5, "same text here now"), (5, "same text here now"), (6, "é" * 70_000), (None, "no id at all"), (7, "7" * 30_000), (8, "@" * 5_000 + "." * 5_000)]
SF = "/root/testdata/sf0.001"


def texts_of(sf: str = SF) -> list[tuple]:
    import duckdb

    return duckdb.execute(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
