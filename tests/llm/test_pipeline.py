import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as p
from tourweave.llm import byte_bpe, near_copies, secret_scan


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.01"
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in p.STAGES:
        out.append(docs)
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
    return [*out, docs]


def test_each_stage_against_brute_force(spark, stages):
    start, quality, dups, leaks, secrets, encoded = (x.toPandas() for x in stages)
    assert list(start.columns) == list(quality.columns) == list(dups.columns) == list(leaks.columns) == list(secrets.columns)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")["quality"]
    dropped = set(start["doc_id"]) - set(quality["doc_id"])
    known = start["doc_id"][start["doc_id"].isin(labels.index)]
    assert np.mean([(i not in dropped) == labels[i] for i in known]) > 0.95

    sets = [near_copies.shingle_set(t.encode()) for t in quality["text"]]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, d in enumerate(quality["doc_id"]):
        least[find(i)] = min(d, least.get(find(i), d))
    assert set(dups["doc_id"]) == set(least.values())

    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").toPandas()["text"]
    whole = {d for d, t in zip(dups["doc_id"], dups["text"]) if any(b in t for b in bench)}
    gone = set(dups["doc_id"]) - set(leaks["doc_id"])
    assert whole <= gone and len(gone) < 1.2 * len(whole) + 2

    before, after = leaks.set_index("doc_id"), secrets.set_index("doc_id")
    changed = 0
    for d, t in before["text"].items():
        spans = secret_scan.find_spans(t, secret_scan.BASE) + secret_scan.find_spans(t, secret_scan.EXTENDED)
        assert (after.loc[d, "text"] == t) == (not spans) and after.loc[d, "n_chars"] == len(after.loc[d, "text"])
        assert all(t[a:b] not in after.loc[d, "text"] for _, a, b in spans)
        changed += bool(spans)
    assert changed and set(after.index) == set(before.index)

    ranks = byte_bpe.parse_ranks(open(public_tokenizers.path(p.VOCABULARY), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, ids, n in zip(encoded["doc_id"], encoded["ids"], encoded["n_tokens"]):
        assert list(ids) == library.encode_ordinary(after.loc[d, "text"]) and n == len(ids)
    assert set(encoded["doc_id"]) == set(after.index)


def test_run_gives_the_last_stage(spark, stages):
    out = p.run(spark, "/root/testdata/sf0.01")
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    """What each stage does to nulls, empty texts and repeated rows; columns beyond those of documents pass."""
    docs, left = odd_docs, []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "encode" or docs.columns == odd_docs.columns
        left.append([tuple(r) for r in docs.collect()])
    by = dict(zip([n for n, _ in p.STAGES], left))
    # one of the copies 1, 2, 2 and one of the texts without words stay; marks stand for secrets
    assert len([r for r in by["near_dups"] if r[0] in (1, 2)]) <= 1 and len([r for r in by["near_dups"] if not (r[1] or "").strip()]) <= 1
    assert all(r in by["quality"] for r in by["near_dups"]) and all(r in by["near_dups"] for r in by["leaks"])
    assert not any("abcdefgh1" in (r[1] or "") for r in by["secrets"]) and len(by["secrets"]) == len(by["leaks"]) == len(by["encode"])
    assert all(n == len(ids) for *_, n, ids in by["encode"])
    docs = no_docs
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
