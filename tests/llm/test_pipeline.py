import corpus_pipeline
import pytest
import small

FOLDER = "/root/testdata/sf0.001"


def folder_of(spark, tmp_path, rows):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch."
    small.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "bpe_encoding"]


def test_every_stage_takes_effect(spark, tmp_path):
    plain = [(100 + i, f"calm words number {i} about rivers and stones {i * i}") for i in range(40)]
    toxic = [(200 + i, f"vile words number {i} about vile rivers {i * i} and stones") for i in range(20)]
    rows = [*small.AWKWARD, *plain, *toxic, (300, "calm copy of a text with words"), (301, "Calm copy of a text with words"),
            (302, "It says: the quick brown fox jumps over the lazy dog while seven wizards watch. So it does."), (303, "a token: abcdefgh1234 here")]
    folder = folder_of(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "bpe_encoding" or docs.columns == before
    assert not kept["toxicity"] & {i for i, _ in toxic} and {i for i, _ in plain} <= kept["toxicity"]
    assert 300 in kept["simhash_near_dedup"] and 301 not in kept["simhash_near_dedup"] and {i for i, _ in plain} <= kept["simhash_near_dedup"]
    assert kept["benchmark_decontamination"] == kept["simhash_near_dedup"] - {302}
    assert kept["secret_scans"] == kept["bpe_encoding"] == kept["benchmark_decontamination"]
    masked = spark.read.parquet(f"{tmp_path}/secret_scans").filter("doc_id = 303").first()
    assert masked["text"] == "a [secret] here"


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [(1, "x")])).count() == 1


def test_queries_are_registered():
    entry = pytest.importorskip("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
