"""Compares the pipeline's near-duplicate stage with an exhaustive search: python tests/llm/measure_recall.py FOLDER... (not a test; check_s takes two minutes)."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def exhaustive(ids: list[int], texts: list[str]) -> tuple[set[int], int, int]:
    """doc_ids of the first document of each group, distinct texts, and links between those: every pair that shares a shingle is counted."""
    first: dict[str, int] = {}
    for i, x in zip(ids, texts, strict=True):
        first[x] = min(i, first.get(x, i))
    own, vocab, sets = list(first.values()), {}, []
    for x in first:
        w = x.encode().lower().split()
        sets.append(np.array(sorted({vocab.setdefault(b" ".join(w[k : k + 5]), len(vocab)) for k in range(max(1, len(w) - 4))} if w else ()), dtype=np.int64))
    n = np.array([len(s) for s in sets])
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    who, ends = who[order], np.searchsorted(flat[order], np.arange(len(vocab) + 1))
    group, links = list(range(len(own))), 0

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def join(i, j):
        nonlocal links
        links += 1
        group[root(i)] = root(j)

    empty = np.flatnonzero(n == 0).tolist()
    for i in empty[1:]:
        join(empty[0], i)
    for i, s in enumerate(sets):
        shared = [who[ends[v] : ends[v + 1]] for v in s if ends[v + 1] - ends[v] > 1]
        if shared:
            both = np.bincount(np.concatenate(shared), minlength=len(sets))
            j = np.flatnonzero(both)
            j = j[(j > i) & (both[j] * 10 >= 8 * (n[i] + n[j] - both[j]))]
            for k in j.tolist():
                join(i, k)
    stays: dict[int, int] = {}
    for i, doc in enumerate(own):
        stays[root(i)] = min(doc, stays.get(root(i), doc))
    return set(stays.values()), len(own), links


def main() -> None:
    import corpus_pipeline
    from tideline.session import get_session

    spark = get_session("recall")
    for folder in sys.argv[1:]:
        docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).persist()
        rows = docs.select("doc_id", "text").collect()
        want, distinct, links = exhaustive([r[0] for r in rows], [r[1] or "" for r in rows])
        got = {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, folder).select("doc_id").collect()}
        print(f"{folder}: {distinct} distinct texts, {links} links, {len(want)} documents stay; the stage keeps {len(got)}, {len(got - want)} too many, {len(want - got)} lost")
        docs.unpersist()


if __name__ == "__main__":
    main()
