"""Phrases, mixes and importance draws against plain Python, with hot keys and small tiles."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.llm import importance, mixing, phrases
from tallycast.llm.store import table

SMALL = "/root/testdata/sf0.01"


def plain_phrases(rows, mining):
    """Every phrase counted in dictionaries."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for size in range(1, mining.longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= mining.least}
        cover = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    cover[p[i : i + size]] = max(cover[p[i : i + size]], a)
        best = []
        for p, a in candidates.items():
            if 100 * cover[p] >= mining.percent * a and p in cover:
                continue
            score, k = min((mining.scale * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[: mining.best], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("mining", [
    phrases.Mining(least=3, dense_bits=4, tile_bits=2, bitmap_bits=8, block_bytes=2_000, best=500),
    phrases.Mining(least=2, longest=4, dense_bits=6, tile_bits=3, percent=80, block_bytes=500, parts=3),
])
def test_phrases_of_skewed_words(spark, mining):
    """A third of all words is one word; blocks, tiles and the bitmap are so small that all of their ways are taken."""
    random.seed(5)
    word = lambda: "The" if random.random() < 0.33 else f"w{int(random.paretovariate(0.7)) % 60}"
    rows = [(random.choice(["en", "en", "de", None]), " ".join(word() + random.choice(["", "", "", ".", ",\t", "\r\n"]) for _ in range(random.randint(0, 40)))) for _ in range(600)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, mining).collect())
    assert got == plain_phrases(rows, mining) and len(got) > 30


def test_tiles_count_like_a_dictionary():
    rng = np.random.default_rng(3)
    left, right = rng.zipf(1.3, 40_000) % 256, rng.zipf(1.3, 40_000) % 256
    mining = phrases.Mining(dense_bits=8, tile_bits=4)
    a, b, n = phrases.tiled(left.astype(np.int64), right.astype(np.int64), mining)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist()))


def plain_mix(rows, mix, percent=100):
    """Water-filling one source at a time, then whole sorted sources."""
    size = defaultdict(int)
    for _, _, source, n in rows:
        size[source] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    held = {}
    while True:
        rest, weights = sum(size.values()) * percent // 100 - sum(held.values()), sum(weight[s] for s in names if s not in held)
        above = [s for s in names if s not in held and mix.most * size[s] * weights < rest * weight[s]]
        if not above:
            break
        held |= {s: mix.most * size[s] for s in above}
    return {s: float(held[s]) if s in held else rest * weight[s] / weights if weights else 0.0 for s in names}


def test_mixes_come_near_their_targets(spark):
    """One source has a third of all words; one is a third of all rows and only copies of one text without an id; one is tiny and stops."""
    random.seed(8)
    rows = [(i, "word " * random.randint(1, 40), random.choice("abcdefg")) for i in range(900)]
    rows += [(10_000 + i, "hot " * 60, "h") for i in range(150)] + [(None, "same text of five", "copies")] * 800 + [(5, "tiny", "tiny"), (6, None, None), (7, "none at all", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mix = mixing.Mix(bits=4)
    percents = (20, 60, 100)
    got = mixing.mixed(docs, mix, percents).collect()
    assert len(got) == len(rows)
    sized = [(r["doc_id"], None, r["source"], r["size"]) for r in got]
    for i, percent in enumerate(percents):
        targets = plain_mix(sized, mix, percent)
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            take = r["takes"][i]
            assert take["percent"] == percent and take["target"] == pytest.approx(targets[r["source"]], rel=1e-12)
            assert take["taken"] <= mix.most * r["size"] and (r["size"] == 0 or take["taken"] % r["size"] == 0)
            taken[r["source"]] += take["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        for source, target in targets.items():
            assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6
    # A smaller budget is part of a larger one.
    assert all(a["taken"] <= b["taken"] for r in got for a, b in zip(r["takes"], r["takes"][1:]))
    assert max(plain_mix(sized, mix).values()) and plain_mix(sized, mix)["tiny"] == 3.0
    again = mixing.mixed(docs.repartition(3), mix, percents).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def plain_features(text):
    folded = re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_importance_against_plain_python(spark):
    docs = {r["doc_id"]: plain_features(r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    corpus, target = Counter(b for _, f in docs.values() for b in f), Counter()
    for row in table(spark, SMALL, "benchmark").collect():
        target.update(plain_features(row["text"])[1])
    s_all, t_all = sum(corpus.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    want = {}
    for doc_id, (_, found) in docs.items():
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        want[doc_id] = (len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((i for i in docs if docs[i][0] >= 20), key=lambda i: (-want[i][2], i))
    rank = {i: place for place, i in enumerate(able[: 5 * len(able) // 100], 1)}
    got = importance.resampled(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: (*w, rank.get(i)) for i, w in want.items()}


def test_checksums_of_runs():
    """Words of all lengths, also beyond those that are hashed together, texts without words, and letters of several bytes."""
    texts = ["", "a", "x" * 200 + " b" + " y" * 40, " \x00 ", "Été 中文 Z9", "q" * 31 + " " + "q" * 32 + " " + "q" * 33 + " " + "q" * 65]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *[len(t.encode()) for t in texts]])
    buckets, of, n_words = importance.buckets_of(data, bounds, importance.Features())
    got = [sorted(np.concatenate([b[t == i] for b, t in zip(buckets, of)]).tolist()) for i in range(len(texts))]
    want = [plain_features(t) for t in texts]
    assert got == [sorted(f) for _, f in want] and n_words.tolist() == [n for n, _ in want]


def test_quickselect_finds_every_place(spark):
    """A third of all rows has one key."""
    rows = [(i % 7, i % 5 if i % 11 else None, i) for i in range(200)] + [(3, 2, 1000 + i) for i in range(100)]
    keys = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    frame = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(4).cache()
    for k in (1, 2, 77, 150, 299, 300):
        assert importance.selected(frame, k, importance.Draw(pivots=5)) == keys[k - 1]
    assert importance.selected(frame, 0, importance.Draw()) is None
    frame.unpersist()
