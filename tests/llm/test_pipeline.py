"""The corpus pipeline against its stages worked out by brute force."""

import random

import corpus_pipeline
from helpers import EDGES, clashing, documents
from test_python import brute_groups, near_copies

from shopledger.llm import bpe, mixing
from shopledger.plans.pinning import pin


def rows():
    rng = random.Random(11)
    out = [(r[0] + 2000, r[1], "en", rng.choice(["a", "b", None]), len(r[1])) for r in near_copies(3, [60, 80, 100], 6)]
    out = list({r[0]: r for r in out}.values())
    out.append((5000, "mail me at someone@example.com " + " ".join(f"z{i}" for i in range(60)), "en", "b", 0))
    return out + EDGES


def test_stages_do_what_they_say(spark):
    docs = documents(spark, rows())
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages][1] == "n-gram Jaccard join" and len(stages) == 5
    one = pin(stages["quality rules"](spark, docs, ""), "s1")
    kept = one.collect()
    assert one.columns == docs.columns and {r["doc_id"] for r in kept} >= {5000} and all(len(r["text"].split()) >= 50 for r in kept)
    two = pin(stages["n-gram Jaccard join"](spark, one, ""), "s2")
    groups = brute_groups([(r["doc_id"], r["text"]) for r in kept], 5, 80)
    assert sorted(str(r["doc_id"]) for r in two.collect()) == sorted({str(g[2]) for g in groups})
    three = pin(stages["PII"](spark, two, ""), "s3")
    assert three.columns == docs.columns and three.count() == two.count()
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    assert texts[5000].startswith("mail me at [EMAIL] z0")
    four = pin(stages["mixing sources to target weights"](spark, three, ""), "s4")
    taken = sum(r["taken"] for r in mixing.mixture(three).collect())
    assert four.columns == docs.columns and sum(len(r["text"].split()) for r in four.collect()) == taken
    five = stages["BPE encoding and decoding"](spark, four, "").collect()
    t = bpe.tokenizer(bpe.vocabulary())
    want = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids)) for r in four.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in five) == want


def test_run_reads_documents_and_survives_extra_columns(spark, tmp_path):
    clashing(documents(spark, rows())).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
