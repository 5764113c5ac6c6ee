"""The pipeline against the brute-force versions of its stages, each on its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import WORD, clean_lines, fingerprint, groups, measures, tokenizer


def test_stages(spark, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rows], columns)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    as_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    good = stages["quality_rules"](spark, docs, "")
    kept = as_rows(good)
    assert good.columns == docs.columns and set(kept) <= {tuple(r[:5]) for r in rows}
    for r in rows:
        m = measures(r[1])
        if m[0] < 10 or 100 * m[4] > 20 * m[0]:
            assert tuple(r[:5]) not in kept

    lines = stages["line_dedup"](spark, good, "")
    wanted = sorted(((d, t, len(t)) for d, _, _, t in clean_lines(kept)), key=str)
    assert lines.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in lines.collect()), key=str) == wanted

    cleaned = as_rows(lines)
    first = stages["simhash_near_dedup"](spark, lines, "")
    group = groups({fingerprint(r[1]) for r in cleaned}, 2)
    stay = {}
    for r in cleaned:
        g = group[fingerprint(r[1])]
        stay[g] = min(stay.get(g, r), r)
    assert as_rows(first) == sorted(stay.values(), key=str)

    mixed = stages["source_mixing"](spark, first, "")
    assert mixed.columns == docs.columns
    whole = {r[0]: r for r in as_rows(first)}
    for r in as_rows(mixed):
        if tuple(r) != whole[r[0]]:  # the one that is cut
            assert WORD.findall(r[1]) == WORD.findall(whole[r[0]][1])[: len(WORD.findall(r[1]))]

    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    t = tokenizer("byte_bpe_50k.json")
    assert sum(r.length for r in packed) == sum(len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in as_rows(mixed))
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_run_and_empty(spark, rows, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs = spark.createDataFrame([], columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.isEmpty()
