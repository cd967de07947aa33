import base64
import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline as pipeline
from tests.llm.test_near_dedup import brute_classes
from vigil.llm import byte_bpe, mixing, quality


def brute(path):
    """The whole pipeline by SQL and plain Python: rows of doc_id, source, number of tokens and digests, with repeats."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality.verdict_sql()}) where kept").fetchall()}
    docs = [r for r in con.sql("select doc_id, text, source from documents order by doc_id").fetchall() if r[0] in kept]
    last = {t: i for i, t, _ in docs}
    docs = [d for d in docs if last[d[1]] == d[0]]
    root = brute_classes([t for _, t, _ in docs])
    docs = [d for k, d in enumerate(docs) if root[k] == k]
    con.sql("create table left_over (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into left_over values (?, ?, ?)", docs)
    copies = dict(con.sql(f"select doc_id, copies from ({mixing.mix_sql('left_over')})").fetchall())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for i, t, s in docs:
        if copies[i]:
            ids = lib.encode_ordinary(t)
            out[i, s, len(ids), byte_bpe.ids_sha256(ids), hashlib.sha256(t.encode()).hexdigest()] += copies[i]
    return out


def test_run_equals_brute_force(spark, sf):
    got = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, sf).collect())
    assert got == brute(f"{sf}/documents.parquet")


def test_stages_keep_the_columns_and_take_nulls_and_empty_tables(spark):
    good = "The pump failed at night, and the crew changed the seal before the morning shift came in {}."
    rows = [(1, None, "en", "a", 0), (2, good.format(1), "en", "a", 1), (3, good.format(1), None, None, 1), (None, good.format("again now"), "en", "b", 1), (5, "", "en", "a", 0)]
    rows = [(*r, 0, 0, 0) for r in [*rows, rows[1], rows[1]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row int, __doc int, kept int")
    for frame in (docs, docs.limit(0)):
        d = frame
        for _, stage in pipeline.STAGES[:-1]:
            d = stage(spark, d, "")
            assert d.columns == docs.columns
        n = pipeline.tokenise(spark, d, "").count()
        assert n == d.count() and (n > 0) == (frame is docs)


def test_the_first_stage_is_native(spark, sf):
    plan = pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_run_with_nulls_ties_and_extra_columns(spark, tmp_path):
    good = "The pump failed at night, and the crew changed the seal before the morning shift came in {}."
    rows = [(1, None, "a"), (2, good.format(1), "a"), (2, good.format(1), "a"), (3, "", None), (None, good.format("and left " * 9), None), (4, good.format(1) * 3000, "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, __row int, __doc int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.source) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) <= {(2, "a"), (None, None)} and got[2, "a"] > 0
