"""The pipeline against plain versions of its stages, on the smallest documents."""

import random

import corpus_pipeline
from fleetgauge.llm import contamination, queries
from fleetgauge.llm.tokens import default_vocabulary, token_ids

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_what_plain_versions_keep(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(after.collect(), after.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    kept, joined, clean, sanitised = seen
    groups = five_word_groups({i: r.text for i, r in kept.items()})
    assert set(joined) == {i for i, g in groups.items() if i == g}
    items = [" ".join(contamination.words_of(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {i for i, r in joined.items() if any(f" {t} " in f" {' '.join(contamination.words_of(r.text))} " for t in items)}
    assert set(clean) == set(joined) - leaked and set(sanitised) == set(clean)
    assert all("@" not in r.text or "[EMAIL]" in r.text or r.text == clean[i].text for i, r in sanitised.items())
    assert all(r.n_chars == len(r.text) for r in sanitised.values())
    packed = corpus_pipeline.pack(spark, docs, SMALL).collect()
    encoder = token_ids(default_vocabulary())
    assert sum(r.length for r in packed) == sum(encoder.count(r.text) + 1 for r in sanitised.values())


def test_run_and_empty_tables(spark, tmp_path):
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.count() > 100 and "sequence_id" in whole.columns
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and len(queries.QUERIES) == 13


def five_word_groups(texts):
    """The smallest id of each id's group, linked by a Jaccard similarity of 0.8 of five-word shingles."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} - {()} for i, w in words.items()}
    group = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_join_stage_links_five_word_shingles_at_four_fifths(spark):
    draw = random.Random(4)
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()
    texts = [None, "", "One two", "one  two", *(r.text for r in given)]
    for length in (4, 5, 20, 50, 200):
        for _ in range(6):
            base = draw.choices([f"w{i}" for i in range(300)], k=length)
            texts.append(" ".join(base))
            for _ in range(draw.randrange(1, 5)):
                copy = list(base)
                for _ in range(draw.randrange(1, 2 + length // 40)):
                    copy[draw.randrange(length)] = "other"
                texts.append(" ".join(copy))
    draw.shuffle(texts)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.join_shingles(spark, docs, SMALL).collect()}
    assert kept == {i for i, g in five_word_groups(dict(enumerate(texts))).items() if i == g}
