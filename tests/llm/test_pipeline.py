import hashlib
import zlib

import corpus_pipeline
from seqlens.llm.packing import _packer  # noqa: F401  the last stage's tokenizer is exercised below
from seqlens.llm.tokens import ChunkIds, tokenizer_path
from tests.conftest import SF001
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_quality import brute as quality_brute
from tests.llm.test_runindex import brute as repeat_brute


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "near_dedup", "repeated_strings", "packing"]

    clean = stages["toxicity"](spark, docs, SF001)
    assert clean.columns == columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert all(i in kept for i, t in labels.items() if t == 0)

    good = stages["quality_rules"](spark, clean, SF001)
    assert good.columns == columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, t in texts.items() if not quality_brute(t)[-1]}

    single = stages["near_dedup"](spark, good, SF001)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in near_brute(rows, 5).items() if i == c}

    cut = stages["repeated_strings"](spark, single, SF001)
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    want = {i: kept.decode("utf-8", "replace") if n else t
            for (i, t), (n, _, kept) in zip(rows, repeat_brute([t.encode() for _, t in rows], corpus_pipeline.REPEAT_BYTES, True))}
    assert cut.columns == columns
    got = cut.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    pieces = stages["packing"](spark, cut, SF001).collect()
    chunks = ChunkIds(tokenizer_path("word_bpe_49k.json"))
    total = {i: len(chunks.encode(t)) // 4 + 1 for i, t in want.items()}
    sums = {}
    for r in pieces:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == total


def test_run_writes_each_stage(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.count() > 0 and "sequence_id" in out.columns
    key = lambda rows: hashlib.md5(str(sorted(map(tuple, rows))).encode()).hexdigest()
    pick = ("doc_id", "start", "length", "ids_crc32")
    assert key(out.select(*pick).collect()) == key(corpus_pipeline.run(spark, SF001).select(*pick).collect())


EXTRA = {"id": "1", "h": "2", "key": "'k'", "n": "3", "score": "0.5", "spans": "'s'", "host": "'x'", "text2": "null"}


def edge_rows(spark):
    prose = " ".join(f"word{i} is number {i}." for i in range(60))
    rows = [(1, prose, "en", "src0", len(prose)), (1, prose, "en", "src0", len(prose)), (2, None, None, None, None),
            (None, prose + " more", "en", None, 5), (None, None, "en", "src1", None), (3, "", "de", "src0", 0),
            (4, "x " * 200_000, "en", "src0", 400_000), (5, " ".join(f"w{i}" for i in range(150_000)), "en", "src2", 9),
            (6, " \n\t ", "en", "src0", 4), (100, prose, "en", "src3", 8), (7, "\x00\x0b é 日本 ﷽ " * 20, None, "src0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_edge_rows_and_empty_tables(spark):
    for docs in (edge_rows(spark), edge_rows(spark).limit(0)):
        wide = docs.selectExpr("*", *[f"{v} AS {k}" for k, v in EXTRA.items()])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, wide, SF001)
            rows = out.collect()
            if name != "packing":
                assert out.columns == wide.columns, name
            assert len(rows) <= wide.count() or name == "packing"
            if not docs.limit(1).count():
                assert rows == [], name
    kept = stagewise = edge_rows(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        stagewise = spark.createDataFrame(stage(spark, stagewise, SF001).collect(), kept.schema)
    got = {r.doc_id: r.text for r in stagewise.collect()}
    assert 5 in got and got[5].startswith("w0 w1 ") and 4 not in got and 3 not in got and 2 not in got


def test_packing_keeps_the_token_ids(spark):
    docs = edge_rows(spark).where("doc_id IN (1, 7)")
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF001).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_repeated_ids_keep_their_text(spark):
    docs = edge_rows(spark)
    prose = docs.where("doc_id = 100").first().text
    stages = dict(corpus_pipeline.STAGES)
    single = spark.createDataFrame(stages["near_dedup"](spark, docs, SF001).collect(), docs.schema)
    cut = stages["repeated_strings"](spark, single, SF001).collect()
    assert [r.text for r in cut if r.doc_id == 1] == [prose]
    assert not [r for r in cut if r.doc_id == 100 or r.doc_id is None and r.text]


def test_queries_on_edge_rows(spark, tmp_path):
    from seqlens.llm import entry
    for name, docs in (("edge", edge_rows(spark)), ("none", edge_rows(spark).limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF001}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        for q, f in entry.queries().items():
            n = f(spark, f"file://{tmp_path}/{name}").count()
            assert n == 0 if name == "none" else n >= {"op8": 1, "op11": 0, "op12": 1}.get(q.split("_")[0], 10), q
