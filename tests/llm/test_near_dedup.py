import random
import re

import pytest

from factmill.llm import near_dedup

from .helpers import documents, empty, prose

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, width, percent):
    sets, ids = [], []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
        ids.append(r[0])
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets)}


def copies(seed):
    """Copies, chains of near copies, and a passage that many texts share."""
    r = random.Random(seed)
    out, base = [], [prose(r, "en", 90).split() for _ in range(3)]
    passage = prose(r, "fr", 60)
    for i in range(60):
        w = list(base[i % 3])
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"w{r.randrange(40)}"
        out.append((500 + i, " ".join(w), None, "a", None, None, None))
    out += [(600 + i, passage + " " + prose(r, "en", r.randint(1, 60)), None, "b", None, None, None) for i in range(30)]
    out += [(700 + i, out[0][1].upper(), None, "b", None, None, None) for i in range(5)]
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components(spark, width):
    docs, rows = documents(spark, 60, 2, copies(width))
    got = near_dedup.near_duplicates(docs, width=width).collect()
    assert len(got) == len(rows)
    assert {(g["doc_id"], g["n_shingles"], g["component_id"]) for g in got} == brute(rows, width, 80)
    assert all(g["kept"] == (g["doc_id"] is None or g["doc_id"] == g["component_id"]) for g in got)
    kept = near_dedup.deduplicated(docs, width=width)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {g["doc_id"] for g in got if g["kept"]}


def test_small_lists_and_empty(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    docs, rows = documents(spark, 5, 3, copies(9)[:40])
    got = near_dedup.near_duplicates(docs, width=2, frequent=0)
    assert {(g["doc_id"], g["n_shingles"], g["component_id"]) for g in got.collect()} == brute(rows, 2, 80)


def test_bound():
    assert near_dedup.certain_overlap(64, 80) < 0.8 * 64
    assert near_dedup.certain_overlap(10, 100) == 10
