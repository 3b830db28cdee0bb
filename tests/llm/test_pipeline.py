"""The pipeline's stages on a small corpus, each against plain Python on what its predecessor kept."""

import hashlib
import math
import re

import corpus_pipeline
from factmill.llm import quality, queries, toxicity

from .test_mixing import brute_targets
from .test_near_dedup import brute
from .test_searches import brute_fit
from .test_text_models import feature_of, labelled, naive_network

LOWER = {i: i + 32 for i in range(65, 91)}
COLUMNS = ["doc_id", "text", "source"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def keys(rows):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in rows)


def toxic(chain, text):
    found = re.findall(rb"[a-z\x80-\xff]+", (text or "").translate(LOWER).encode())
    seen = set(found) | {w[:n] + b"*" for w in found for n in (4, 5, 6) if len(w) >= n}
    columns = {int(chain.slot[feature_of(x)]) for x in seen} - {-1}
    base, earlier = int(chain.slot.max()) + 1, []
    for w, b in zip(chain.weights, chain.biases, strict=True):
        z = b + sum(float(w[c]) for c in columns) + sum(float(v) * p for v, p in zip(w[base:], earlier, strict=True))
        earlier.append(1 / (1 + math.exp(-z)))
    return earlier[-1]


def mixed(rows):
    """How often each row is taken: whole epochs, then a prefix in the order of a hash."""
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    out = []
    for source, target in brute_targets(sizes).items():
        own = [r for r in rows if r["source"] == source]
        own.sort(key=lambda r: (int(hashlib.md5(f"20250824:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:15], 16), words(r["text"])))
        epochs, left = divmod(math.floor(target), sizes[source]) if sizes[source] else (0, 0)
        for r in own:
            n = words(r["text"])
            taken = epochs * n + max(0, min(n, left))
            left -= n
            out += [r] * (math.ceil(taken / n) if n else 0)
    return out


def test_stages(spark, tmp_path):
    docs, _, labels, truth = labelled(spark)
    docs = docs.where("doc_id is null or length(text) < 3000 or text is null")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    tables = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    given, good, polite, single, mixture = (t.collect() for t in tables[:5])
    # 1, 2: what the fitted models say, window by window and word by word
    net = quality.fit(tables[0], labels, mod=None)
    assert keys(good) == keys(r for r in given if naive_network(net, (r["text"] or "").encode()) >= 0.5)
    chain = toxicity.fit(toxicity.labelled(tables[1], labels, mod=None))
    assert keys(polite) == keys(r for r in good if toxic(chain, r["text"]) < 0.5)
    clean = {i for i, (q, t) in truth.items() if q == 1 and t == 0 and i is not None and i < 500}
    assert len(clean - {r["doc_id"] for r in polite}) <= 2
    # 3: one row of each component; rows without an id stay once a text
    found = brute([tuple(r) for r in polite], 5, 80)
    kept = {i for i, _, c in found if i is not None and i == c}
    want = {(r["doc_id"], r["text"]) for r in polite if r["doc_id"] is None or r["doc_id"] in kept}
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in single)
    # 4: every row as often as the mixture takes it
    assert keys(mixture) == keys(mixed(single))
    # 5: all words, in bins that best fit gives for their pieces in order
    packed = tables[5].collect()
    assert sum(r["n_words"] for r in packed) == sum(words(r["text"]) for r in mixture)
    text_of = {r["doc_id"]: r["text"] for r in mixture}
    part = [r for r in packed if (r["bin_id"] or "").startswith("bin-0-")]
    part.sort(key=lambda r: (-r["n_words"], r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["piece"], r["copy"]))
    number = lambda known, x: -1 if x is None else known.setdefault(x, len(known))
    sources, texts = {}, {}
    bins = brute_fit([(r["n_words"], number(sources, r["source"]), number(texts, text_of[r["doc_id"]])) for r in part], 1024)
    named = {}
    assert all(named.setdefault(b, r["bin_id"]) == r["bin_id"] for b, r in zip(bins, part, strict=True)) and len(set(named.values())) == len(named) > 0
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "copy", "piece").collect())) == sorted(str(r) for r in tables[5].select("doc_id", "copy", "piece").collect())


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
