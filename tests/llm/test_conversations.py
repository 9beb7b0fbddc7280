"""Conversation repair and prefix trie against plain versions, long and odd conversations, and the network's slopes."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import conversation_repair, language_id, prefix_trie, queries

BLANK = re.compile(r"[^\x20\x09-\x0D]")
FIRST = lambda x: (x is not None, x)  # noqa: E731  nulls first


# repair


def cheapest(symbols):
    """The cheapest edits by a search over places and states of the language's automaton, right to left."""
    step = {("start", "s"): "sys", ("start", "u"): "user", ("sys", "u"): "user", ("user", "a"): "end", ("end", "u"): "user"}

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(symbols):
            if state in ("start", "end"):
                found.append((0, ""))
        else:
            c, a = best(i + 1, state, 0)
            found.append((c + 2, "D" + a))
            if (x := symbols[i]) != "x":
                more = 5 * x.isupper()
                for role, cost, edit in ((x.lower(), 0, "K"), ("u", 1, "R"), ("a", 1, "R")):
                    if (state, role) in step:
                        c, a = best(i + 1, step[state, role], 0)
                        found.append((c + cost + more, edit + a))
        if inserted < 3:
            for role in "ua":
                if (state, role) in step:
                    c, a = best(i, step[state, role], inserted + 1)
                    found.append((c + 5, "I" + a))
        return min(found, default=(10**9, "~"))

    return best(0, "start", 0)


def plain_repair(rows):
    """Reports and digests of all conversations, row by row."""
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own = held[conv]
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (FIRST(r[0]), r[1], hashlib.md5(f"{'~' if conv is None else conv}:{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        counts, seen, symbols = collections.Counter(), set(), ""
        for _, role, text in own:
            marks = BLANK.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            first = role[0] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else first.upper() if fault else first
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(symbols)
        kept, rest, total = [], iter(own), len(audit) - audit.count("D")
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(rest)[1:]
            if edit != "D":
                kept.append(f"{role if edit == 'K' else ('user', 'assistant')[(len(kept) - total % 2) % 2]}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, digest string, kind int, edge boolean"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, None) for r in rows], SCHEMA)


def reported(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


def odd_rows():
    draw = random.Random(3)
    rows = [(1, None, "user", "no turn."), (1, None, None, None), (1, 0, "system", "s."), (2, 0, "", ""), (2, 1, "tool", "x" * 200_000 + "."), (None, 0, "user", "of none."), (None, 1, "assistant", "of none!"), (3, 5, "user", "a."), (3, 5, "user", "a."), (3, 5, "user", "b."), (3, -4, "assistant", "\x85é?"), (4, 0, "user", " \t\r\n\x0b\x0c")]
    for conv in range(10, 90):
        for turn in range(draw.randrange(1, 9)):
            rows.append((conv, turn * draw.choice((1, 1, 2)), draw.choice(("user", "assistant", "system", "tool", None)), draw.choice(("yes.", "no", "why?", "", None, "so be it!"))))
    for turn in range(400):  # one long conversation
        rows.append((7, turn, draw.choice(("user", "assistant")), f"text {turn % 350}{draw.choice(('.', ''))}"))
    return rows


def test_repair_against_a_plain_one(spark, work, sf):
    rows = odd_rows()
    want = plain_repair(rows)
    assert reported(conversation_repair.repair(conversations(spark, rows), work)) == want
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    assert reported(queries.op11_conversation_repair(spark, sf)) == plain_repair([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])


def test_a_conversation_in_many_partitions(spark, work):
    rows = odd_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert reported(conversation_repair.repair(conversations(spark, rows), work)) == plain_repair(rows)
        found = prefix_trie.prefix_trie(conversations(spark, rows), work, 40)
        assert trie(found) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_charts_hold_the_cheapest_edits(n):
    for symbols in itertools.product("usaoUSAOx" if n < 4 else "usaAx", repeat=n):
        cell = conversation_repair.chart("".join(symbols))
        assert min(x for s in conversation_repair.START if (x := cell[s]) is not None) == cheapest("".join(symbols))


def test_spans_combine_to_the_same_cells():
    draw = random.Random(1)
    for _ in range(30):
        symbols = "".join(draw.choice("usaoUSAx") for _ in range(draw.randrange(60)))
        spans = conversation_repair.Spans()
        for part in re.findall("..?.?", symbols):
            spans.add(part)
        cell = spans.cell()
        assert min(x for s in conversation_repair.START if (x := cell[s]) is not None) == cheapest(symbols)


def test_repaired_rows_alternate(spark, work):
    rows = conversation_repair.repaired(conversations(spark, odd_rows()), work).orderBy("conv_id", "position").collect()
    for _, own in itertools.groupby(rows, key=lambda r: r.conv_id):
        own = list(own)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))


def test_no_conversations(spark, work):
    none = conversations(spark, odd_rows()).limit(0)
    assert conversation_repair.repair(none, work).count() == 0
    assert prefix_trie.prefix_trie(none, work).count() == 0


def test_dropped_rows_leave_an_empty_conversation(spark, work):
    conv = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = reported(conversation_repair.repair(conversations(spark, [(conv, 0, "user", "gone.")]), work))
    assert found == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


# trie


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda r: (FIRST(r[0]), r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    nodes, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - conv % 100
        whole = tuple(t[1:] for t in (own.get(base, [])[:h] + turns[h:] if base != conv else turns))
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(conv)
        ends[whole].append(conv)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(ends[k])) for k, m in nodes.items())


def trie(found):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect())


def made_conversations():
    draw = random.Random(9)
    rows = [(100, t, "user", f"base {t}") for t in range(3)] + [(101, 0, None, None), (None, 0, "user", "of none"), (102, None, "user", "late"), (102, 3, "user", "y")]
    for conv in range(200, 420):
        for turn in range(draw.randrange(1, 7)):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], draw.choice("abc") * draw.randrange(1, 3)))
    rows += [(conv, t, "system", f"common {t}") for conv in range(1000, 1400) for t in range(7)]
    return rows


@pytest.mark.parametrize("few", [1, 1 << 16])
def test_trie_against_a_plain_one(spark, work, few):
    rows = made_conversations()
    found = prefix_trie.prefix_trie(conversations(spark, rows), work, few).cache()
    assert trie(found) == plain_trie(rows)
    places = sorted(x for r in found.collect() for x in (r.enter, r.exit))
    assert places == list(range(2 * found.count()))


def test_trie_query_against_plain_and_sql(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = trie(queries.op12_prefix_trie(spark, sf))
    assert found == plain_trie([tuple(r) for r in given.collect()])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(db.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op12_prefix_trie']})").fetchall()) == found


def test_list_ranks_by_splicing(spark, work):
    n = 3000
    order = list(range(n))
    random.Random(2).shuffle(order)
    rows = [((a, 0), (b, 0) if b is not None else None, 1, a % 3, a) for a, b in zip(order, [*order[1:], None], strict=True)]
    runs = spark.createDataFrame(rows, "run struct<conv: long, slot: long>, next struct<conv: long, slot: long>, arcs long, leaves long, saved long")
    found = {r.run.conv: (r.arcs, r.leaves, r.saved) for r in prefix_trie.list_ranks(runs, work, 100).collect()}
    at, leaves, saved = 0, 0, 0
    for a in order:
        assert found[a] == (at, leaves, saved)
        at, leaves, saved = at + 1, leaves + a % 3, saved + a


# languages


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id.new_weights(rng, 3, 4).items()}
    codes, labels, weight = rng.integers(97, 105, (6, 5)), np.array([0, 1, 2, 1, 0]), np.array([1.0, 0.5, 2, 1, 1])
    _, made = language_id.slopes(w, codes, labels, weight)
    for k, v in w.items():
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in v.shape) if k[:2] != "in" else (int(codes[0, 0]), int(rng.integers(0, v.shape[1])))
            old, step = v[i], 1e-3
            v[i] = old + step
            up = language_id.slopes(w, codes, labels, weight)[0]
            v[i] = old - step
            down = language_id.slopes(w, codes, labels, weight)[0]
            v[i] = old
            assert made[k][i] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_windows_pool_to_the_mean_of_all_positions():
    rng = np.random.default_rng(4)
    w = language_id.new_weights(rng, 3)
    texts = ["a", "", "word " * 100, "né" * 64, "x" * 129]
    chance, sizes = language_id.chances(w, pa.array(texts))
    for text, got, n in zip(texts, chance, sizes, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert n == len(raw)
        total = np.zeros(3)
        for k in range(0, len(raw), language_id.WINDOW):
            odds = language_id.position_odds(w, raw[k : k + language_id.WINDOW][:, None], None)[:, 0]
            total += (np.exp(odds) / np.exp(odds).sum(1, keepdims=True)).sum(0)
        assert got == pytest.approx(total / max(1, len(raw)), abs=1e-4)


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    true = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    found = queries.op13_language_id(spark, sf).collect()
    assert len(found) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(true[r.doc_id][0] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_languages_of_odd_rows(spark, odd, empty):
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd).collect()} == {("und", 0.0)}  # nothing to learn
    assert language_id.identify(empty).count() == 0
    rows = [(i, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") * 9, ("en", "de")[1 - i % 2]) for i in range(300)] + [(None, "the dog", None), (301, None, "en"), (302, "123 ,.", "de"), (303, "", "en"), (304, "und die " * 90_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS held_out")
    found = language_id.identify(docs).collect()
    by = {r.doc_id: r.lang_pred for r in found}
    assert all(by[i] == ("en" if i % 2 else "de") for i in range(300))
    assert (by[301], by[302], by[303], by[304]) == ("und", "und", "und", "de")
