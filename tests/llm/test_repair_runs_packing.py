"""Conversation repair, periodic runs and packing against plain versions, SQL and awkward tables."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing, periodic_runs, queries, repair
from tests.oracle import assert_same

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start string, ids string, runs string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], DOCS)


def awkward(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice("abc") for _ in range(40_000))
    return docs(spark, [(1, "one two " * 5), (1, "one two " * 5), (None, "a a a a a a a b"), (2, None), (3, ""), (4, " \n\t"), (5, long), (6, "x" * 20_000), (None, None), (7, "é\x00 ß  \U0001f600 \x1c z")])


# --- 11 -------------------------------------------------------------------------------------------------------------


def plain_repair(codes):
    """The least (cost, audit) by searching over all audits in order, with no weights: Dijkstra over strings."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(codes) and last in ("", "a"):
            return cost, audit
        if (i, last) in seen:
            continue
        seen.add((i, last))
        heapq.heappush(heap, (cost + 5, audit + "I", i, after[last]))
        if i < len(codes):
            role, fault = codes[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if fault in "nt":
                paid = cost + 5 * (fault == "t")
                if role == after[last] or (role == "s" and not last):
                    heapq.heappush(heap, (paid, audit + "K", i + 1, role))
                if role != after[last]:
                    heapq.heappush(heap, (paid + 1, audit + "R", i + 1, after[last]))
    raise AssertionError


code = st.builds(lambda r, f: r + f, st.sampled_from("suua."), st.sampled_from("nnntbd"))


@settings(max_examples=400, deadline=None)
@given(st.lists(code, max_size=24))
def test_weights_decide_as_a_search_does(codes):
    assert repair.cheapest(codes) == plain_repair(codes)


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(2)
    for n in (1, 5, 127, 128, 129, 700):
        codes = [rng.choice("suua.") + rng.choice("nntbd") for _ in range(n)]
        whole = plain_repair(codes)
        for piece in (1, 7, 128, 1000):
            monkeypatch.setattr(repair, "PIECE", piece)
            assert repair.cheapest(codes) == whole


def test_repair_query(spark, sf_dir):
    assert_same(queries.op11_repair(spark, sf_dir), queries.oracle_sql()["op11_repair"], sf_dir)


TURNS = "conv_id long, turn long, role string, text string, pos string, code string, facts string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURNS)


def plain_conversation(rows):
    """Facts and repaired turns of rows (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "n"
        seen.add((role, text))
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else ".") + fault)
    cost, audit = plain_repair(codes)
    out, at, last = [], 0, ""
    for letter in audit:
        need = "user" if last in ("", "s", "a") else "assistant"
        row = None if letter == "I" else rows[at]
        at += letter != "I"
        if letter != "D":
            role = row[1] if letter == "K" else need
            out.append(f"{role}:{row[2] if row else ''}")
            last = role[0]
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    count = lambda f: sum(c[1] == f for c in codes)
    illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(codes, codes[1:], strict=False))
    return gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def facts_of(df):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_repair_on_awkward_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, null ids, and conversations without rows."""
    rng = random.Random(7)
    rows = [(None, None, None, None), (None, 2, "user", "Hm."), (None, 2, "user", "Hm."), (1, None, "user", "a."), (1, None, "assistant", "b!"), (2, 5, None, "x" * 200_000), (2, 9, "", ""), (3, 0, "tool", "t."), (3, 0, "system", "t.\n"), (3, 1, "superuser", "é?  ")]
    rows += [(4 + rng.randint(0, 12), rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(["user", "assistant", "assistant", "system", None, "x"]), rng.choice(["", " ", None, "a.", "b.", "c", "d? ", "e\n"])) for _ in range(150)]
    rows += [(50, k, rng.choice(["user", "assistant"]), f"turn {k}" + rng.choice([".", ""])) for k in range(3000)]
    also = spark.createDataFrame([(99,), (None,), (1,)], "conv_id long")
    found = facts_of(repair.digests(repair.repair(turns(spark, rows), also)))
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(rest)
    assert found == {conv: plain_conversation(g) for conv, g in groups.items()} | {99: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_tells_the_turns_that_are_left(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "cut"), (1, 3, "assistant", "Bye.")]
    found = repair.repair(turns(spark, rows)).where("step is not null").select("step", "edit", "role", "text").collect()
    assert [tuple(r) for r in found] == [(0, "K", "system", "Be kind."), (1, "R", "user", "Hello."), (3, "K", "assistant", "Bye.")]


def test_repair_of_nothing(spark):
    assert facts_of(repair.digests(repair.repair(turns(spark, []), spark.createDataFrame([], "conv_id long")))) == {}


def test_damage_takes_nulls(spark):
    left, lost = repair.damaged(turns(spark, [(None, k if k else None, None, None) for k in range(80)]))
    kinds = [zlib.crc32(f" :{k if k else ' '}".encode()) % 20 for k in range(80)]
    assert lost.count() == kinds.count(0) and left.count() == 80 - kinds.count(0) + kinds.count(3)
    assert {r["role"] for r in left.collect()} == {" ", "user"} and {r["text"] for r in left.collect()} == {" ", ""}


# --- 12 -------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    """Every lag over the whole text; a run's period is tried against all smaller ones."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


repeated = st.builds(lambda unit, n: (unit * 70)[:n], st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.integers(0, 60))
texts = st.lists(st.one_of(repeated, st.lists(st.sampled_from("abcdefgh"), max_size=15)), max_size=5).map(lambda parts: [w.encode() for p in parts for w in p])


@settings(max_examples=400, deadline=None)
@given(texts)
def test_runs_are_those_of_all_lags(words):
    runs = periodic_runs.runs_of(words)
    assert runs == plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    assert periodic_runs.collapsed(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def test_splitting_ends_with_frequent_words_only():
    rng = random.Random(3)
    for _ in range(100):
        words = np.array([rng.choice([0, 1, 2, rng.randint(3, 30)]) for _ in range(rng.randint(0, 200))], np.int64)
        parts = periodic_runs.stable_segments(words)
        assert all(b - a >= 6 and np.bincount(words[a:b])[words[a:b]].min() >= 4 for a, b in parts)
        inside = {i for a, b in parts for i in range(a, b)}
        assert all(set(range(s, s + n)) <= inside for s, n, _ in plain_runs(words.tolist()))


@pytest.mark.parametrize("text", ["a " * 60_000, " ".join(str(k % 9_000) for k in range(60_000)), "a b " * 20_000 + "c " * 20_000, " ".join(random.Random(1).choice("ab") for _ in range(60_000))])
def test_runs_of_long_texts_take_little_longer_than_their_length(text):
    import time

    words = text.encode().split()
    took = []
    for part in (words[: len(words) // 4], words):
        began = time.thread_time()
        periodic_runs.runs_of(part)
        took.append(time.thread_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_runs_query(spark, sf_dir):
    assert_same(queries.op12_periodic_runs(spark, sf_dir), queries.oracle_sql()["op12_periodic_runs"], sf_dir)


def test_runs_on_awkward_rows(spark):
    found = periodic_runs.digests(periodic_runs.collapse_runs(awkward(spark), planted=periodic_runs.planted_period())).collect()
    assert len(found) == 10
    nothing = hashlib.sha256(b"").hexdigest()
    for r in found:
        if r["doc_id"] in (2, 3, 4):
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == (0, None, None, None, None, nothing, nothing)
    none = [r for r in found if r["doc_id"] is None]
    assert sorted((r["n_runs"], r["length"]) for r in none if r["n_runs"]) == [(1, 7)] and len(none) == 2
    assert periodic_runs.collapse_runs(awkward(spark).limit(0)).collect() == []


# --- 13 -------------------------------------------------------------------------------------------------------------


def check_packed(rows, expected, capacity=4096):
    """``expected``: ids of each document in a list by doc_id; each id must lie in exactly one piece, sequences be gapless."""
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0  # full or a power of two: no padding
    assert sum(r["length"] for r in rows) == sum(len(ids) for many in expected.values() for ids in many)
    for (doc_id, _), parts in pieces.items():
        if len(expected[doc_id]) == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(expected[doc_id][0])
                assert r["ids_crc32"] == zlib.crc32(np.array(expected[doc_id][0][at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(expected[doc_id][0])
    return sequences


def ids_of(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_query(spark, sf_dir):
    rows = queries.op13_packing(spark, sf_dir).collect()
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_packed(rows, {r["doc_id"]: [ids] for r, ids in zip(source, ids_of([r["text"] or "" for r in source]), strict=True)})


def test_packing_on_awkward_rows(spark):
    table = awkward(spark)
    expected = {}
    for r, ids in zip(table.collect(), ids_of([r["text"] or "" for r in table.collect()]), strict=True):
        expected.setdefault(r["doc_id"], []).append(ids)
    rows = packing.digests(packing.pack(table.repartition(3), WORDS)).collect()
    check_packed(rows, expected)
    small = packing.digests(packing.pack(table, WORDS, capacity=64)).collect()
    check_packed(small, expected, 64)
    assert packing.pack(table.limit(0), WORDS).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé'Σσ \n ́`1½<|>z", max_size=30), max_size=8))
def test_words_encode_as_whole_texts_do(texts):
    encode = packing.word_encoder(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [x[:-1] for x in ids_of(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=40), st.integers(0, 7))
def test_fill_loses_and_repeats_nothing(lengths, spare):
    room = [64] * max(0, sum(lengths) // 64 - spare)
    made, left = packing.fill(lengths, room)
    places = sorted((k, at, n) for _, _, k, at, n in made) + left
    covered = sorted((k, i) for k, at, n in places for i in range(at, at + n))
    assert covered == [(k, i) for k, n in enumerate(lengths) for i in range(n)]
    used = [0] * len(room)
    for s, offset, *_, n in sorted(made):
        assert offset == used[s]
        used[s] += n
    assert used == room  # there is always enough to fill them


def test_costs_are_balanced():
    """Sequences cost nearly the same but for those that a long document makes dear by itself; filling in order of arrival
    spreads them by hundreds."""
    rng = random.Random(8)
    lengths = [min(4096, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(4000)]
    room = [4096] * (sum(lengths) // 4096)
    costs, longest = np.zeros(len(room)), np.zeros(len(room), int)
    for s, *_, n in packing.fill(lengths, room)[0]:
        costs[s] += packing.cost_of(n)
        longest[s] = max(longest[s], n)
    naive, widest, at = np.zeros(len(room) + 1), np.zeros(len(room) + 1, int), 0
    for n in lengths:
        while n:
            part = min(n, 4096 - at % 4096)
            naive[at // 4096] += packing.cost_of(part)
            widest[at // 4096] = max(widest[at // 4096], part)
            at, n = at + part, n - part
    plain = costs[longest < 1024]
    assert len(plain) > 50 and np.ptp(plain) < 0.01 * plain.mean()
    assert np.ptp(plain) < 0.1 * np.ptp(naive[:-1][widest[:-1] < 1024])
