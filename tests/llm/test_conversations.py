import hashlib
import heapq
import random
import re
import zlib

from callgrain.llm import conversations as op
from callgrain.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """Damaged rows per conversation in order, and all ids."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        kept += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def fault(seen, role, text):
    ink = re.sub(r"[\x20\x09-\x0D]", "", text)
    return 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0


def brute(rows):
    """(cost, edits, repaired) by a search over (rows used, repaired text), cheapest and ASCII-least first."""
    faults, seen = [], set()
    for _, role, text in rows:
        faults.append(fault(seen, role, text))
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, edits, at, out = heapq.heappop(heap)
        shape = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r, _ in out)
        if at == len(rows) and legal.fullmatch(shape):
            return cost, edits, out
        # only what can still become legal, and one entry for what has the same future
        if not any(legal.fullmatch(shape + end) for end in ("", "ua", "a")) or (at, shape[-1:], len(shape) > 0) in done:
            continue
        done.add((at, shape[-1:], len(shape) > 0))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, edits + "I", at, (*out, (name, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, out))
            if faults[at] not in (1, 2):
                extra = 3 if faults[at] == 3 else 0
                heapq.heappush(heap, (cost + extra, edits + "K", at + 1, (*out, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + extra, edits + "R", at + 1, (*out, (name, text))))


def expected(rows):
    out = []
    for conv, kept in damaged(rows).items():
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, counts = set(), [0, 0, 0, 0]
        for _, role, text in kept:
            counts[fault(seen, role, text)] += 1
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, fixed = brute(kept)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, counts[1], counts[2], counts[3], illegal, cost, audit, digest))
    return sorted(out, key=str)


def corpus(seed, n, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "Ursula", "umpire"])
            text = rng.choice(["Yes.", "No", "why? ", "\t\n", "", None, "Done!\n", "é. x", "ok.", f"n {rng.random()}.", "日本！"])
            rows.append((conv, turn if rng.random() > 0.05 else None, role, text))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    return rows


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_search(spark):
    rows = corpus(1, 400) + [(None, 1, "user", "hm."), (None, 2, "assistant", "so."), (None, None, "user", "hm.")]
    rows += [(1000, 0, "user", "long " * 100_000 + "."), (1000, 1, "assistant", "x" * 500_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", present_ int, cost int")
    assert got(op.repair(op.damage(df))) == expected(rows)


def test_every_dropped_row_keeps_its_conversation(spark):
    lost = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "x.")]
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(op.repair(op.damage(spark.createDataFrame(rows, SCHEMA)))) == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)] == expected(rows)


def test_long_conversation_spills(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_ROWS", 7)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}.", ""])) for t in range(700)]
    rows += corpus(3, 30)
    df = op.damage(spark.createDataFrame(rows, SCHEMA))
    plain, spilled = got(op.repair(df)), got(op.repair(df, spill_rows=20))
    assert plain == spilled == expected(rows)


def test_repaired_turns(spark):
    rows = corpus(4, 120)
    df = op.damage(spark.createDataFrame(rows, SCHEMA))
    repaired = op.stored(op.repair(df), "repaired")
    turns = {}
    for r in op.repaired_turns(df, repaired).orderBy("conv_id", "position").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repaired.collect():
        assert hashlib.sha256("\n".join(turns.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_batches_do_not_matter(spark):
    rows = corpus(6, 60)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(op.repair(op.damage(spark.createDataFrame(rows, SCHEMA)))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_shuffle(spark, tmp_path):
    spark.createDataFrame(corpus(7, 5), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = op._ordered(op.damage(spark.read.parquet(f"{tmp_path}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty(spark):
    assert got(op.repair(op.damage(spark.createDataFrame([], SCHEMA)))) == []


def test_query(spark, tmp_path):
    rows = corpus(8, 50)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == expected(rows)
