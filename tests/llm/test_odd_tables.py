"""Empty tables, and extra columns whose names clash with an operator's own: the same results as without."""

import pytest
from pyspark.sql import functions as F

from vigilake.llm import chat_format, conversation_repair, embedding_dedup, fingerprints, html_extract, language_id, merkle, mixing, packing, secret_scan, sentencepiece_codec, simhash_dedup, warc

tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["One two three four. Token = abcdefgh12345678", None, "", "Der Hund und die Katze sind im Haus. " * 9, "The dog and the cat are in the house. " * 9, "The dog and the cat are in the house. " * 9]
DOCS = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
PAGES = [(i, f"http://h{i % 2}.example/p{i}", f"<html><body><nav>menu</nav><article><h1>Title {i}</h1><p>Some words of page {i}. {'More. ' * 200}</p></article></body></html>" if i else None) for i in range(6)]
TURNS = [(c, t, ["user", "assistant"][t % 2], f"Turn {t} of {c}.") for c in range(4) for t in range(4)]
VECTORS = [(i, [1.0, float(i % 3), 0.5], i % 2) for i in range(12)]
TABLES = {
    "documents": (DOCS, "doc_id long, text string, lang string, source string, n_chars long"),
    "pages": (PAGES, "page_id long, url string, html string"),
    "conversations": (TURNS, "conv_id long, turn long, role string, text string"),
    "embeddings": (VECTORS, "vec_id long, embedding array<float>, label int"),
}
OPERATORS = {
    "op1": ("documents", simhash_dedup.near_duplicates),
    "op2": ("embeddings", embedding_dedup.near_duplicates),
    "op3": ("documents", lambda d: sentencepiece_codec.encode_and_decode(d, tokenizers.path("piece_bpe_32k.model"))),
    "op4": ("documents", secret_scan.scan),
    "op5": ("conversations", chat_format.format_conversations),
    "op6": ("documents", language_id.identify),
    "op7": ("pages", warc.archive_pages),
    "op8": ("pages", html_extract.extract),
    "op9": ("documents", fingerprints.fingerprint_edits),
    "op10": ("documents", lambda d: packing.pack(d, tokenizers.path("word_bpe_49k.json"))),
    "op11": ("conversations", conversation_repair.repair_damaged),
    "op12": ("documents", lambda d: mixing.mix(d).select("doc_id", "size", "source_size", "target", "copies")),
    "op13": ("documents", merkle.manifest),
}
CLASHING = ["id", "rep", "v", "n", "fingerprint", "h", "part", "pos", "key", "a", "b", "component", "score", "block", "piece", "start", "words", "spans", "kind", "digest", "record", "schema", "ids", "host", "node", "size", "value"]


@pytest.mark.parametrize("op", OPERATORS)
def test_odd_tables(spark, op):
    table, run = OPERATORS[op]
    df = spark.createDataFrame(*TABLES[table]).coalesce(1)
    plain = run(df)
    more = run(df.withColumns({c: F.lit("mine") for c in CLASHING if c not in df.columns}))
    shown = [c for c in plain.columns if c not in ("sequence_id", "offset")]  # any numbers do
    rows = lambda d: sorted(map(repr, d.select(*shown).collect()))
    want = rows(plain)
    assert want and rows(more) == want
    empty = run(df.filter("false"))
    assert empty.columns == plain.columns and empty.collect() == []
