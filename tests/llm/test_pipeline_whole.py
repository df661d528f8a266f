"""The whole pipeline on some hundred shuffled rows, every stage against plain Python on what the stage before kept."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, packing, quality

WORDS = {
    "en": "the of and to in that was his with from they this have which were there been their would when".split(),
    "de": "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf eine auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, gone_ int, word_ string, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", str(rng.randrange(30))]) for _ in range(n))


def rows_of(seed=17):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", "fr"])
        rows.append((i, prose(rng, lang, rng.randrange(40, 160)), lang))
    for i in range(40):  # near copies, some of copies
        base = rng.choice(rows)
        ws = base[1].split(" ")
        ws[rng.randrange(len(ws))] = "changed"
        rows.append((300 + i, " ".join(ws), base[2]))
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(15)]  # copies
    rows += [(500, None, "en"), (501, "", None), (502, "123 456 !!", "en"), (503, "too short", "en"), (504, " ".join(["again and again the same"] * 40), "en")]
    rows += [(None, prose(rng, "en", 80), "en"), (None, rows[3][1], "en"), (7, rows[7][1], rows[7][2])]
    rows += [(600 + i, prose(rng, "en", 60) + f" password = hunter{i}secret{i} and AKIA{'ABCDEFGH' * 2}{i} " + prose(rng, "en", 20), "en") for i in range(8)]
    rows += [(700, prose(rng, "de", 30_000), "de")]
    rng.shuffle(rows)
    return rows


def near_copies(rows):
    """Places of the rows that go: all but the least id of each component of similarity 0.8 over five words."""
    sets = []
    for _, text in rows:
        ws = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    known = [i for i, (doc, _) in enumerate(rows) if doc is not None and sets[i]]
    holders = defaultdict(list)
    for i in known:
        for g in sets[i]:
            holders[g].append(i)
    pairs = Counter((a, b) for hs in holders.values() for k, a in enumerate(hs) for b in hs[k + 1 :])
    for (a, b), n in pairs.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            top[find(b)] = find(a)
    least = {}
    for i in known:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return {i for i in known if rows[i][0] != least[find(i)]}


def bag(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, 2, "w", "x") for i, t, lang in rows_of()], SCHEMA)
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_on_what_the_one_before_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    # Language: a main language of each text.
    d = stages["language_id"](spark, docs, folder)
    sure = docs.join(langid.predict(docs.withColumn("doc_id", F.xxhash64("text")), langid.train(docs)).select(F.col("doc_id").alias("h"), "lang_pred", "score").distinct(), F.xxhash64("text") == F.col("h"))
    want = Counter((r.doc_id, r.text) for r in sure.collect() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE and r.text)
    assert bag(d) == want and not {i for i, _ in want} & {500, 501, 502} and len(want) > 300 and d.columns == docs.columns
    before = d

    # Quality: at least ten words, at most a fifth of them in repeated windows, and the log ratio.
    d = stages["quality_rules"](spark, before, folder)
    ratio = quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = Counter()
    for (doc, text), n in bag(before).items():
        ws = WORD.findall(text)
        at = defaultdict(list)
        for i in range(len(ws) - 4):
            at[tuple(ws[i : i + 5])].append(i)
        again = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
        (verdict,) = quality.verdicts([text], ratio, quality.THRESHOLD)
        assert verdict[5] == (len(ws) < 10 or 100 * len(again) > 20 * len(ws)) and verdict[4] == len(again)
        if verdict[6]:
            kept[doc, text] = n
    assert bag(d) == kept and 503 not in {i for i, _ in kept} and 504 not in {i for i, _ in kept} and len(kept) > 250
    before = d

    # Near copies: the least id of each component.
    d = stages["ngram_jaccard_join"](spark, before, folder)
    rows = [key for key, n in bag(before).items() for _ in range(n)]
    gone = near_copies(rows)
    assert bag(d) == Counter(r for i, r in enumerate(rows) if i not in gone) and len(gone) > 30
    before = d

    # Secrets: replaced, everything else as it was.
    d = stages["secret_scans"](spark, before, folder)
    old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in d.collect()}
    for doc, r in new.items():
        assert r.n_chars == len(r.text)
        if doc is not None and 600 <= doc < 700:
            assert "hunter" not in r.text and "AKIA" not in r.text and r.text.count("[SECRET]") == 2
        else:
            assert r.text == old[doc].text or doc is None
    before = d

    # Packing: every word in one place, batches within the budget.
    packed = stages["packing"](spark, before, folder).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
    words = Counter()
    for (doc, text), n in bag(before).items():
        words[doc] += n * len(WORD.findall(text))
    assert tokens == words
    sizes = Counter(r.batch_id for r in packed)
    assert all(sizes[r.batch_id] * r.bucket_len <= packing.BUDGET and r.n_tokens <= r.bucket_len for r in packed)

    # In one go
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, r.piece, r.n_tokens) for r in packed)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
