"""The pipeline's stages, each on what the one before kept, against brute force."""

from __future__ import annotations

import corpus_pipeline as P
from test_operators import WORD, brute_components, brute_hits, brute_pii

from corpusmill.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [name for name, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pii", "source_mixing"]
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for _, _, c in brute_components([(i, r.text) for i, r in before.items()])}
        elif name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not brute_hits(r.text, items)[1]}
        elif name == "pii":
            assert set(after) == set(before)
            for i, r in after.items():
                assert brute_pii(r.text) == "" and (r.text == before[i].text or brute_pii(before[i].text) or "[" in r.text)
                assert r.n_chars == len(r.text)
        else:
            assert set(after) <= set(before)
            assert all(0 < r.taken <= 2 * len(WORD.findall(before[i].text)) for i, r in after.items())
        if name != "source_mixing":
            assert docs.columns == columns
    assert P.run(spark, SF).count() == docs.count()


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, repeated rows, shared and missing doc_ids, empty tables, columns of other names."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, "quite another text", "en", "a", 5), (None, text, None, None, None), (None, "no id here", "en", None, 1), (None, "no id here", "en", None, 1), (2, None, "en", "a", 1), (3, "", "en", "a", 1), (4, " 123 ", "en", "b", 1), (5, text + " more", "en", "b", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    kept = P.drop_near_copies(spark, docs, SF).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [rows[0], rows[2], rows[4], *rows[6:9]]))
    assert sorted(str(r.text) for r in P.identify_language(spark, docs, SF).collect()) == sorted(str(r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert P.drop_contaminated(spark, docs, SF).count() == P.mask_personal_data(spark, docs, SF).count() == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in P.mask_personal_data(spark, docs, SF).collect())
    assert all(r.taken > 0 for r in P.mix_sources(spark, docs, SF).collect())
    none, extra = spark.createDataFrame([], schema), docs.selectExpr("*", "'x' as score", "'y' as Spans", "'z' as N_Words", "'k' as key")
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0
        assert stage(spark, extra, SF).count() == stage(spark, docs, SF).count()
