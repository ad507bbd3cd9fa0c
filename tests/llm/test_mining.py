"""Mixing, phrases and vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import codes, mixing, phrases

DOCS = "doc_id long, text string, source string, lang string, size long, item int, n int, key string, rank long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


# Mixing


def mixed(seed=5, n=900):
    rng, rows = random.Random(seed), []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(5)}"
        text = " ".join("w" * rng.randint(1, 6) for _ in range(int(rng.paretovariate(0.8)) % 3000))
        rows.append((i, text, source))
    rows += [(5000, None, "hot"), (5001, "", "hot"), (5002, " \t\n", "empty"), (5003, "a\x0bb c  d\re", None), (5004, "x " * 40_000, "s1")]
    rows += [(6000, "same words again", "hot")] * 70 + [(None, "one two", "s0")] * 5
    return [(*r, "en", 7, 8, 9, "k", 10) for r in rows]


def wanted_targets(rows):
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall("[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and left / w * weight[s] > 3 * sizes[s]} if w else set()
        if not above:
            return sizes, {s: 3.0 * sizes[s] if s in full else left / w * weight[s] for s in order}
        full |= above


@pytest.mark.parametrize("seed", [5, 6])
def test_a_mix_comes_near_its_targets_in_whole_copies(spark, seed):
    rows = mixed(seed)
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, targets = wanted_targets(rows)
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[2]) for r in rows)
    taken, least, most = defaultdict(int), defaultdict(lambda: 1 << 40), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        least[r["source"]] = min(least[r["source"]], r["size"] or 1 << 40)
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s in sizes:
        if most[s] > targets[s]:  # one document is more than all that its source may give
            assert 0.9 * 3 * (sizes[s] - most[s]) <= taken[s] <= most[s]
            continue
        assert abs(taken[s] - targets[s]) <= max(0.01 * targets[s], min(least[s], 1 << 20) if sizes[s] else 0)


def test_reruns_agree_however_rows_are_dealt(spark):
    rows = mixed()
    one, two = mixing.mix(frame(spark, rows)), mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(7))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))


def test_documents_are_taken_with_equal_chances(spark):
    rows = [(i, "a " * (1 + i % 50), f"s{i % 2}", "en", 1, 1, 1, "k", 1) for i in range(6000)]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frame(spark, rows)).collect()}
    rate = {s: np.mean([copies[i] for i in range(6000) if i % 2 == s]) for s in (0, 1)}
    for s in (0, 1):
        for lo in range(0, 50, 10):  # long and short alike
            some = [copies[i] for i in range(6000) if i % 2 == s and lo <= i % 50 < lo + 10]
            assert abs(np.mean(some) - rate[s]) < 0.1
        assert {copies[i] for i in range(6000) if i % 2 == s} <= {math.floor(rate[s]), math.floor(rate[s]) + 1, math.floor(rate[s]) - 1}


def test_many_equal_rows_share_copies_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(1, "a b c", "x", "en", 1, 1, 1, "k", 1)] * 100 + [(2, "a " * 100, "y", "en", 1, 1, 1, "k", 1)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 101
    x = [r for r in got if r["source"] == "x"]
    assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 3
    assert max(r["copies"] for r in x) - min(r["copies"] for r in x) <= 1


def test_a_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    only = mixing.mix(frame(spark, [(1, None, None, "en", 1, 1, 1, "k", 1)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)]


# Phrases


def brute_phrases(rows, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, _, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        own = {p: a for p, a in c.items() if a >= 10 and len(p) > 1}
        found = []
        for p, a in own.items():
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in own.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 50 * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def spoken(seed=9):
    rng, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(25)] + ["New", "York", "CITY", "été", " ", "\U0001f600", "a\x1cb"]
    for i in range(260):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\r\n", ". ", "\x0b"]) for _ in range(rng.randint(0, 90)))
        text += rng.choice(["", "New York City is old", "new york city", "of of of of"])
        rows.append((i, text, "s", rng.choice(["en", "de", None, "und"]), 1, 1, 1, "k", 1))
    return rows + [(900, None, "s", "en", 1, 1, 1, "k", 1), (901, "", "s", "fr", 1, 1, 1, "k", 1), (902, "solo", "s", "", 1, 1, 1, "k", 1)] + rows[:9] * 3


@pytest.mark.parametrize("slice_, top", [(2 << 20, 2000), (300, 7)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, slice_, top):
    monkeypatch.setattr(phrases, "SLICE", slice_)
    rows = spoken()
    got = {tuple(r) for r in phrases.collocations(frame(spark, rows), top=top).collect()}
    assert got == brute_phrases(rows, top) and len(got) > 15


def test_a_very_long_text_is_counted_whole(spark):
    text = " ".join(f"x{k % 7} y{k % 11}" for k in range(300_000)) + ". " + "tail end, " * 12
    rows = [(1, text, "s", "en", 1, 1, 1, "k", 1)]
    assert {tuple(r) for r in phrases.collocations(frame(spark, rows)).collect()} == brute_phrases(rows)


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_end_where_pieces_do():
    text = b"aa bb, cc dd. ee" * 50 + b" z" * 900
    parts = list(phrases.pieces(text, 64))
    assert b"".join(parts) == text.translate(phrases._MARKS)
    assert all(p.endswith(b"\n") for p in parts[:-1])


def test_cells_are_packed_and_unpacked():
    cells, counts = np.array([0, 1, 255, 70_000, (1 << 24) - 1], np.uint64), np.array([1, 10, 3, 9, 10])
    back = phrases.unpacked(phrases.packed(cells, counts), True)
    assert back[0].tolist() == cells.tolist() and back[1].tolist() == counts.tolist()
    assert phrases.unpacked(phrases.packed(cells[:0]), False)[0].tolist() == []


# Codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, l) for i, v, l, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[math.floor(4096 * x) if abs(x) < 2**40 else int(x) * 4096 for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut(whole[k], p) for k in order] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: [min(range(len(books[p])), key=lambda e: (distance(cut(v, p), books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        of = [assign(v) for v in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(whole, of) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    rows_, labels = [], defaultdict(int)
    for (i, _, l), v in zip(kept, whole):
        c = assign(v)
        error = sum(distance(cut(v, p), books[p][c[p]]) for p in range(parts))
        rows_.append((i, l, "".join(f"{x:02x}" for x in c), error))
        labels[l] += error
    fits = lambda x: x if x < 1 << 63 else None
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    whole_label = {l: None if any(r[1] == l and fits(r[3]) is None for r in rows_) else fits(s) for l, s in labels.items()}
    return Counter((i, l, c, fits(e), whole_label[l], digest) for i, l, c, e in rows_)


def embedded(seed, n=150, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) / 8
    return [(int(i), [float(np.float32(x)) for x in centres[rng.integers(20)] + rng.normal(size=dim) * rng.choice([0, 0.01, 0.1])], [None, 1, 2, 3][i % 4], "x") for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("case", ["plain", "odd", "few", "uneven", "large"])
def test_codes_are_those_of_brute_force(spark, case):
    rows, schema = embedded(4), SCHEMA
    if case == "odd":
        rows += [(900, None, 1, "x"), (901, [None] * 64, 1, "x"), (902, [float("nan")] * 64, 2, "x"), (903, [float("inf")] * 64, 2, "x"), (None, rows[0][1], 1, "x"), (3, rows[7][1], 3, "x"), rows[9], rows[9]]
    if case == "few":
        rows = rows[:5]
    if case == "uneven":
        rows = [(i, v[: 61 - i % 5], l, c) for i, v, l, c in rows] + [(990, [], 1, "x")]
    if case == "large":
        schema = schema.replace("float", "double")
        rows = rows[:40] + [(700, [1e30] * 64, 1, "x"), (701, [-1e9] * 64, 2, "x"), (702, [3e5, -3e5] * 32, 2, "x"), (-1, [2e4] * 64, 3, "x")]
    got = Counter(tuple(r) for r in codes.compress(frame(spark, rows, schema)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows)


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 5, 8, 16):
        entries = rng.integers(-3000, 3000, (16, width))
        x = np.concatenate([rng.integers(-3000, 3000, (300, width)), entries + rng.integers(-2, 3, (16, width)), np.repeat(entries[:1], 3, 0)])
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        code, error = codes.nearest(x, entries)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    assert codes._segments(8)[0].tolist() == [0] and codes._segments(8)[-1].tolist() == [0, 2, 4, 6]


def test_codes_of_nothing(spark):
    assert codes.compress(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).count() == 0


def test_hot_labels_are_looked_up_apart(spark, monkeypatch):
    from tracewell.llm import shared

    monkeypatch.setattr(shared, "MOST_SENT", 1)
    monkeypatch.setattr(shared, "HOT", 0.4)
    rows = spark.createDataFrame([(k, None if k < 6 else k % 3) for k in range(12)], "id long, label int")
    keys = rows.groupBy("label").agg({"id": "sum", "*": "count"}).toDF("label", "n", "total").select("label", "total", "n")
    keys = rows.groupBy("label").count().withColumnsRenamed({"count": "n"}).selectExpr("label", "n", "n * 10 AS ten")
    got = sorted((r["id"], r["ten"]) for r in shared.look_up(rows, keys, "label", "n").collect())
    assert got == [(k, 60 if k < 6 else 20) for k in range(12)]
