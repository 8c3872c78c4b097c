"""The whole pipeline against its stages worked out row by row, and what it leaves behind."""

import hashlib
import os
import random
import struct
import zlib
from collections import Counter

import public_tokenizers as P
from test_operators import distance, prose, roots, shares, toxic_score, variants, words
from tokenizers import Tokenizer

from keyfold.llm import mixing, toxicity
from keyfold.llm.queries import END_ID, MIX_SEED, REST, WEIGHTS


def shingles(text):
    w = (text or "").lower().split()
    return shares(" ".join(w), 5) or ({tuple(w)} if w else set())


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def copies(row, mean):
    doc_id, text, source = row
    m = mean[source if source in WEIGHTS else "rest"]
    key = f"{'' if doc_id is None else doc_id}|{hashlib.md5((text or '').encode()).hexdigest()}"
    assert m < mixing.PART
    u = int(hashlib.md5(f"{MIX_SEED}|1|{key}".encode()).hexdigest()[:13], 16) / 2**52
    return sum(c <= u for c in mixing.poisson_cdf(m))


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    item, short = prose(rng, 30), "two words"
    bad = ["awfulword", "nastything", "horridname"]
    texts = [*variants(rng, 8, 400, 2), *variants(rng, 6, 60, 1), *[prose(rng, 100) for _ in range(40)], *[prose(rng, 30) + " " + item for _ in range(5)]]
    clean = len(texts)
    for i in range(240):
        w = prose(rng, 40).split()
        if i % 3 == 0:
            for _ in range(4):
                w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w))
    rows = [*enumerate(texts), (None, None), (None, texts[0]), (900, ""), (901, None), (902, " \n"), (3, texts[3]), (904, prose(rng, 3)), (905, short)]
    table = docs(rows)
    folder = f"{tmp_path}/t"
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, short), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(clean + i, int(i % 3 == 0)) for i in range(240)] + [(None, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(table, labels)

    left = [(i, t, f"src{k % 3}") for k, (i, t) in enumerate(rows) if toxic_score(model, t or "") < toxicity.THRESHOLD]
    assert sum(1 for i, _, _ in left if i is not None and clean <= i < 900) in range(150, 172)
    sets = {k: shingles(t) for k, (i, t, _) in enumerate(left) if i is not None}
    root = roots(list(sets), [(a, b) for a in sets for b in sets if a < b and (near(sets[a], sets[b]) if sets[a] and sets[b] else sets[a] == sets[b])])
    best = {}
    for k, r in root.items():
        if r not in best or left[k][0] < left[best[r]][0]:
            best[r] = k
    left = [row for k, row in enumerate(left) if row[0] is None or k in best.values()]
    assert Counter(i for i, _, _ in left if i is not None and i < 14) == {0: 1, 8: 1} and 901 not in {i for i, _, _ in left}
    left = [row for row in left if distance(words(item), words((row[1] or "").lower())) > int(0.2 * 30)]
    counts = Counter(s if s in WEIGHTS else "rest" for _, _, s in left)
    mean = mixing.rates(counts, {**WEIGHTS, "rest": REST}, 1.0)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for row in left:
        ids = [*tok.encode(row[1] or "", add_special_tokens=False).ids, END_ID]
        want[row[0], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += copies(row, mean)
    out = corpus_pipeline.run(spark, folder)
    found = out.collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == +want and len(found) > 100
    starts = sorted((r["start"], r["n_tokens"]) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    left_over = os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/keyfold")
    assert [f for f in left_over if f.startswith("stage-")] and not [f for f in left_over if f.startswith(("stage-toxicity", "stage-mixing", "classes", "wanted", "confirmed", "lanes"))]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, folder).columns == table.columns
    empty = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
