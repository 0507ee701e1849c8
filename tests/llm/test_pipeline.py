import random

import corpus_pipeline
from spanloom.llm import decontam
from tests.llm.test_bpe import WANT
from tests.llm.test_langid import WORDS
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_groups



def prose(seed, lang, n):
    r = random.Random(seed)
    own = random.Random(f"own{seed % 10**6}")
    return " ".join(r.choice(WORDS[lang]) + (own.choice(["", r.choice(WORDS[lang])])) for _ in range(n))


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    items = [(i, prose(900_000 + i, "en", 20).capitalize() + ". " + prose(950_000 + i, "en", 8).capitalize() + ".") for i in range(10)]
    texts = []
    for d in range(90):
        lang = sorted(WORDS)[d % 3]
        texts.append("\n".join(prose(1000 * d + k, lang, r.randrange(15, 60)) for k in range(r.randrange(1, 5))))
    for d in range(0, 30, 3):  # near copies: few words changed, lines put together anew
        own = texts[d].replace("\n", " ").split()
        own[r.randrange(len(own))] = "changed"
        half = len(own) // 2
        texts.append(" ".join(own[:half]) + "\n" + " ".join(own[half:]))
    for i in range(5):
        texts.append(prose(700_000 + i, "en", 30) + "\n" + items[i][1] + "\n" + prose(710_000 + i, "en", 30))
    texts += [texts[1], "漢字仮名" * 9, "", None]
    docs = [(i, t, ["de", "en", "fr"][i % 3] if i < 90 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t in enumerate(texts) if t and "漢" not in t]
    _, after = brute_lines(kept)
    kept = sorted(after.items())
    groups = brute_groups(kept)
    kept = [x for x in kept if x[0] not in groups]
    kept = [(d, t) for d, t in kept if not any(decontam.ngrams(decontam.tokens(q)) <= decontam.ngrams(decontam.tokens(t)) for _, q in items)]
    want = {d: WANT.encode_ordinary(t) for d, t in kept}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(x.round_trip for x in got)
    assert {x.doc_id: x.token_ids for x in got} == want
    assert len(groups) >= 8 and not any(d in want for d in range(100, 105)) and 90 >= len(want) > 70


def test_columns(spark, docs, tmp_path):
    df = docs(["the one text of some words here", None, ""])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).schema.simpleString() == df.schema.simpleString()
