"""The pipeline against a plain Python version of its five stages, row by row."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_native import python_features, python_own, python_targets
from test_neardup import brute
from tokenizers import Tokenizer

import corpus_pipeline
from pagelattice.llm import flat, toxicity

SF = "/root/testdata/sf0.01"


def plain_score(text, model):
    """The chain's marginals by forward and backward sums, a token at a time, and the score from them."""
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    emit = []
    for s, e in spans:
        word = np.frombuffer(raw[s:e], np.uint8)
        forms = flat.hash_spans(word, np.array([0]), np.array([len(word)]), lower=True, heads=toxicity.HEADS)
        emit.append(model.bias + sum(float(model.weights[int(f[0]) >> (64 - toxicity.BITS)]) for f in forms))
    moves = model.moves
    ahead, behind = [], [(0.0, 0.0)]
    for k, x in enumerate(emit):
        own = (0.0, max(-40.0, min(40.0, x)))
        ahead.append(own if not k else tuple(own[b] + np.logaddexp(ahead[-1][0] + moves[0, b], ahead[-1][1] + moves[1, b]) for b in (0, 1)))
    for x in emit[:0:-1]:
        nxt = (behind[-1][0], behind[-1][1] + max(-40.0, min(40.0, x)))
        behind.append(tuple(np.logaddexp(moves[a, 0] + nxt[0], moves[a, 1] + nxt[1]) for a in (0, 1)))
    p = [1 / (1 + math.exp(min(700, (f[0] + b[0]) - (f[1] + b[1])))) for f, b in zip(ahead, behind[::-1], strict=False)]
    x = np.array([1, math.log(0.3 + sum(max(0.0, y - toxicity.FAINT) for y in p)) if p else math.log(0.3), max(p, default=0.0)])
    return 1 / (1 + math.exp(-max(-40, min(40, float(x @ model.head)))))


def plain_mix(rows, block_words=1 << 16):
    """How often each row is taken."""
    sizes = Counter()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, text, source in rows:
        sizes[source] += size(text)
    wanted, md5 = python_targets(sizes), lambda x: hashlib.md5(x.encode()).hexdigest()
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    times = [0] * len(rows)
    for place, source in enumerate(names, 1):
        if not sizes[source]:
            continue
        units = {}
        for k, (d, t, s) in enumerate(rows):
            if s == source:
                units.setdefault(md5(f"{'null' if d is None else d}:{md5(t or '')}"), []).append(k)
        words = {key: sum(size(rows[k][1]) for k in ks) for key, ks in units.items()}
        n = max(1, math.ceil(sizes[source] / block_words))
        blocks = {}
        for key in sorted(units):
            blocks.setdefault(int(key[:6], 16) % n, []).append(key)
        passes = math.floor(wanted[source] / sizes[source])
        rest = math.floor(wanted[source] + 0.5) - passes * sizes[source]
        taken = dict.fromkeys(units, passes)
        for block in sorted(blocks, key=lambda b: (md5(f"{place}:{b}:block"), b)):
            own = sum(words[key] for key in blocks[block])
            if own <= rest:
                for key in blocks[block]:
                    taken[key] += 1
            elif rest > 0:
                room, picked = rest, set()
                for key in blocks[block]:
                    room -= words[key]
                    if room < 0:
                        break
                    picked.add(key)
                for _ in range(4):
                    gap = rest - sum(words[key] for key in picked)
                    best = min((key for key in blocks[block] if key not in picked), key=lambda key: (abs(words[key] - gap), key), default=None)
                    if best is not None and abs(words[best] - gap) < gap:
                        picked.add(best)
                for key in picked:
                    taken[key] += 1
            rest -= own
        for key, ks in units.items():
            for k in ks:
                times[k] = taken[key]
    return times


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()
    rng = random.Random(1)
    some = [r for r in rows if len(r[1] or "") > 300]
    for k in range(30):
        d, text, lang, source, n = rng.choice(some)
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append(((None, d, 50_000 + k)[k % 3], text if k % 4 == 0 else " ".join(words), lang, None if k % 5 == 0 else source, n))
    rows += [(60_000, None, None, "src1", None), (60_001, "", "en", "src2", 0), (60_002, " \n ", "en", None, 3), (60_003, "one", "en", "src3", 3), (60_003, "one", "en", "src3", 3), (None, "two words", None, None, None), (60_004, "long " + "word " * 30_000 + " ".join(f"w{k}" for k in range(70_000)), "en", "src3", 0)]
    return rows


def test_the_whole_pipeline_like_plain_python(spark, tmp_path, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))

    passed = []
    for row in documents:
        n, _, _, _, repeats = python_features(row[1])
        if n >= 1 and 100 * repeats <= 30 * n and not python_own(row[1]):
            passed.append(row)
    assert 0 < len(passed) < len(documents)

    stage1 = spark.createDataFrame(passed, df.schema).coalesce(1)
    model = toxicity.fit_from(stage1, labels.where(~toxicity.held_out()))
    scores = [plain_score(r[1], model) for r in passed]
    got = toxicity.score(stage1.withColumn("doc_id", F.monotonically_increasing_id()), model).orderBy("doc_id").collect()
    assert np.allclose(scores, [r.score for r in got], atol=1e-6)
    clean = [r for r, s in zip(passed, scores, strict=True) if s < 0.5]
    assert 0 < len(clean) < len(passed)

    named = [k for k, r in enumerate(clean) if r[0] is not None]
    groups = {}
    for k, (_, component) in brute([(k, clean[k][1]) for k in named], 5, 80).items():
        groups.setdefault(component, []).append(k)
    stay = {min(ks, key=lambda k: (clean[k][0], k)) for ks in groups.values()} | (set(range(len(clean))) - set(named))
    kept = [clean[k] for k in sorted(stay)]
    assert len(kept) < len(clean)

    times = plain_mix([(r[0], r[1], r[3]) for r in kept])
    bpe, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for (doc_id, text, *_), n in zip(kept, times, strict=True):
        ids = bpe.encode(text or "", add_special_tokens=False).ids
        decoded = bpe.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += n

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    assert found == +want and any(k[0] is None for k in found) and max(found.values()) > 1


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 0


def test_stages_keep_clashing_columns(spark):
    clash = ("row", "doc", "kept", "got", "score", "spans", "component", "component_id", "shard", "position", "key", "place", "draw", "_id", "_row", "_times", "_a", "n_words")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in clash})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.select(*clash).distinct().collect()] == [clash]
    assert pa.array([r.n_tokens for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()]).null_count == 0
