"""Conversation repair against trying all edits, and on awkward rows."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import repair

KIND = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
WORDLESS = " \t\n\x0b\x0c\r"


@functools.lru_cache(None)
def plain_search(symbols):
    """All edits of a short conversation, cheapest first, then in ASCII order."""
    most = 3 * len(symbols)
    found = []

    def go(i, cost, audit, initials):
        if cost > most:
            return
        if i == len(symbols) and PATTERN.fullmatch(initials):
            found.append((cost, audit))
        go_on = (lambda x: PATTERN.fullmatch(initials + x) or PATTERN.fullmatch(initials + x + "a") or initials + x == "s")
        for x in "ua":
            if go_on(x):
                go(i, cost + 2, audit + "I", initials + x)
        if i < len(symbols):
            fault, initial = divmod(int(symbols[i], 16), 4)
            go(i + 1, cost + 3, audit + "D", initials)
            if fault < 2:
                for x in "ua":
                    if go_on(x):
                        go(i + 1, cost + 2 + fault, audit + "R", initials + x)
                x = "suax"[initial]
                if x != "x" and go_on(x):
                    go(i + 1, cost + fault, audit + "K", initials + x)

    go(0, 0, "", "")
    return min(found)


def test_search_finds_the_cheapest():
    for n in range(4):
        for symbols in itertools.product("0123456789ab", repeat=n) if n < 3 else random.Random(1).sample(list(itertools.product("012345678c", repeat=3)), 150):
            symbols = "".join(symbols)
            assert repair.search(symbols) == plain_search(symbols), symbols


def test_search_of_longer_ones_and_its_bounds():
    rng = random.Random(2)
    for _ in range(25):
        symbols = "".join(rng.choice("0112256939") for _ in range(4))
        cost, audit = repair.search(symbols)
        assert (cost, audit) == plain_search(symbols)
        assert repair.bounds(symbols)[0] <= cost


def test_search_of_a_very_long_conversation():
    symbols = "".join(random.Random(3).choice("012456789abc") for _ in range(20_000))
    cost, audit = repair.search(symbols)
    assert cost == repair.bounds(symbols)[0] and len(audit.replace("I", "")) == len(symbols)


def plain_damage(rows):
    out = collections.defaultdict(list)
    for r in rows:
        own = out[r[0]]
        space = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{space(r[0])}:{space(r[1])}".encode()) % 20
        role, text = space(r[2]), space(r[3])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub(r"[.!?]", "", text)
        elif kind == 4:
            role = "user"
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        own += [((r[1] is not None, r[1] or 0, key), r[1], role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: [r[1:] for r in sorted(own, key=lambda r: r[0])] for c, own in out.items()}


def plain_repair(rows):
    out = {}
    for conv, own in plain_damage(rows).items():
        seen, symbols, illegal = set(), "", 0
        for n, (_, role, text) in enumerate(own):
            bare = text.rstrip(WORDLESS)
            fault = 2 if not bare else 3 if (role, text) in seen else 1 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            initial = "sua".find(role[:1]) if role else -1
            symbols += f"{4 * fault + (initial if initial >= 0 else 3):x}"
            illegal += n > 0 and own[n - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(int(s, 16) // 4 == f for s in symbols) for f in (2, 3, 1)]
        cost, audit = plain_search(symbols) if len(symbols) < 5 else repair.search(symbols)
        left, lines, initials = iter(own), [], ""
        for e in audit:
            _, role, text = next(left) if e != "I" else (None, None, "")
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if initials.endswith("u") else "user"
            initials += role[:1]
            lines.append(f"{role}:{text}")
        assert PATTERN.fullmatch(initials)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *faults, illegal, cost, audit, digest)
    return out


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(4)
    texts = ["One.", "Two!", "three", "Four? \n\t", "", None, " \x0b\f\r", "five .x", "Ünf ", " "]
    roles = ["user", "assistant", "system", "tool", None, "", "umpire", "User"]
    rows = []
    for c in range(250):
        for t in range(rng.randint(1, 4)):
            rows.append((c, t if rng.random() < 0.8 else rng.choice([None, 0, 9]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)))
    rows += rows[:40]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, None, None, None)]
    rows += [(900, t, ("user", "assistant")[t % 2], f"{t} is a turn.") for t in range(6000)]
    rows += [(901, 0, "user", "Long text. " * 200_000), (901, 1, "assistant", "." * 500_000 + " " * 500_000)]
    rows += [(902, 5, "user", "again.")] * 300
    return rows


def got(df):
    out = repair.repaired(df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = out.collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_repaired(spark, awkward):
    df = spark.createDataFrame(awkward, KIND).repartition(6)
    for c in ("copies", "DIGEST", "pos", "mark", "head", "audit", "symbols", "own"):
        df = df.withColumn(c, F.lit(c))
    want, have = plain_repair(awkward), got(df)
    assert have.keys() == want.keys()
    assert {c: (have[c], w) for c, w in want.items() if have[c] != w} == {}


def test_symbols_in_runs(spark, awkward, monkeypatch):
    monkeypatch.setattr(repair, "RUN", 3)
    assert got(spark.createDataFrame(awkward, KIND)) == plain_repair(awkward)


def test_all_rows_gone_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], KIND)
    assert got(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(df.limit(0)) == {}
