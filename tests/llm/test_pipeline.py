import corpus_pipeline as p

from skyvane.llm.decontamination import find_overlaps
from skyvane.llm.secrets import find_secrets
from skyvane.llm.simhash import near_duplicates, similar_cut


def test_every_stage_takes_effect(spark):
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    bad = {r[0] for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 0").select("doc_id").collect()}
    kept = []
    for name, stage in p.STAGES[:-1]:
        out = p.cut(stage(spark, docs, small))
        assert out.columns == docs.columns and out.schema == docs.schema, name
        kept.append((docs, out))
        docs = out
    (raw, good), (_, unique), (_, clean), (_, safe) = kept
    assert 0 < raw.count() - good.count() and len(bad & {r[0] for r in good.select("doc_id").collect()}) <= len(bad) / 4
    assert unique.count() == near_duplicates(good, cut_=similar_cut(0.8), shingle=5).select("root").distinct().count() < good.count()
    assert clean.count() == find_overlaps(unique, bench).where("n_hit = 0").count() < unique.count()
    assert safe.count() == clean.count() and find_secrets(safe).where("is_secret").count() == 0
    packed = p.STAGES[-1][1](spark, safe, small)
    assert packed.select("doc_id").distinct().count() == safe.count()


def test_run(spark, small):
    assert p.run(spark, small).count() > 0


def test_stages_on_odd_rows(spark, small):
    text = "The quiet river runs along the old stone bridge near our village. " * 4
    rows = [(1, None, "en", "a", None, 1, 0.5), (2, "", "en", "a", 0, 2, 0.5), (3, text, "en", "a", 9, 3, 0.5), (3, text, "en", "a", 9, 3, 0.5), (4, text + "More here.", None, None, 9, 4, None), (None, "password = 'Zx9kQ2mmPd81vTr4'", "en", "a", 9, 5, 0.5), (7, "word " * 40_000, "en", "a", 9, 6, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_hit int, score double")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        got = out.collect()
        assert 0 < len(got) <= len(rows) and {tuple(r)[5] for r in got} <= {r[5] for r in rows}, name
        assert stage(spark, docs.limit(0), small).count() == 0, name
    kept = sorted(r.n_hit for r in p.simhash_near_dedup(spark, docs, small).collect())
    assert kept == [1, 3, 5, 6]  # null and empty texts are one group, copies and the near copy another
    assert sorted(r.n_hit for r in p.benchmark_decontamination(spark, docs, small).collect()) == [1, 2, 3, 3, 4, 5, 6]
    safe = {r.n_hit: r for r in p.secret_scans(spark, docs, small).collect()}
    assert "Zx9kQ2mm" not in safe[5].text and safe[5].n_chars == len(safe[5].text) and (safe[1].text, safe[1].n_chars) == (None, None)
    packed = p.best_fit_packing(spark, docs, small)
    assert packed.select("doc_id", "piece").count() >= len(rows) and p.best_fit_packing(spark, docs.limit(0), small).count() == 0
