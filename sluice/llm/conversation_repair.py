"""Repairs the structure of conversations at the least cost, by Knuth's lightest derivations.

**Deductions.**  A conversation's rows are read by a small automaton for the
roles ``(s?(ua)+)?``.  Items are spans ``(i, q)`` - the first i rows are dealt
with and the automaton is in state q - and edits of one row, which are axioms.
A hyperedge takes a span and an edit of its next row to the next span; a unary
one inserts a turn.  An item's weight is ``(cost, audit)``, the audit being the
initials of the edits so far.  Deductions add costs and append letters, which
is monotone, and superior: no result is lighter than what it is made of.  (Of
two audits for one item with equal costs neither is a prefix of the other, as
each further insertion costs something, so appending keeps their order.)  So
items leave the agenda by weight, each final when first popped, until the goal
item does: the cheapest repair, among equals the ASCII-least audit.

**Scale.**  Rows are sorted over the whole table by range, so a conversation of
any length is spread over tasks.  A task cuts its rows into runs of at most
``RUN`` rows.  A run that is a whole conversation is derived to its goal; any
other gets the lightest weight for each pair of states that it may be entered
and left in, and a conversation's runs are put together from these tables
alone.  Texts are only ever held for a run, and the digest of a repaired
conversation is fed run by run.  Audits are part of the result, so what is held
for one conversation grows by one character a row.

Defined cases: a null role or text is one space; null turns come first; rows of
one turn are ordered by role, then by the SHA-256 of the text; repeated rows
are rows; a null conversation id is a conversation; empty and very long texts
are rows like others; no rows give no conversations.  Only the four named
columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .common import bound_batches, col, table

#: Rows of a run, and bytes of text after which it is cut too.
RUN = 512
RUN_BYTES = 2 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\f\r"
#: The automaton of (s?(ua)+)?: state and role initial to state.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
#: The one role that a rerole or an insertion can give in each state.
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def lightest(axioms: list, deduce, goals: int) -> dict:
    """Knuth's algorithm: the lightest weight of each item, until ``goals`` goal items are final.

    ``axioms`` are (weight, item); ``deduce(item, weight)`` yields (weight,
    item, whether a goal) for what follows from a final item.
    """
    agenda = [(weight, item, False) for weight, item in axioms]
    heapq.heapify(agenda)
    chart: dict = {}
    while agenda and goals:
        weight, item, is_goal = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = weight
        if is_goal:
            goals -= 1
            continue
        for found in deduce(item, weight):
            if found[1] not in chart:
                heapq.heappush(agenda, found)
    return chart


def edits(initial: str, fault: str, state: int):
    """(cost, letter, next state) of the edits that a row allows in ``state``; faults are b, d, t or -."""
    yield DELETE, "D", state
    if fault in "bd":
        return
    extra = TRUNCATED if fault == "t" else 0
    kept = STEP.get((state, initial))
    if kept is not None:
        yield KEEP + extra, "K", kept
    yield REROLE + extra, "R", STEP[state, ROLE[state][0]]


def _spans(initials: list[str], faults: str, whole: bool):
    n = len(initials)

    def deduce(item, weight):
        i, state = item
        cost, audit = weight
        if i == n:
            if not whole:
                yield weight, (n + 1, state), True
            elif state in ACCEPT:
                yield weight, (n + 1, 0), True
        else:
            for more, letter, to in edits(initials[i], faults[i], state):
                yield (cost + more, audit + letter), (i + 1, to), False
        yield (cost + INSERT, audit + "I"), (i, STEP[state, ROLE[state][0]]), False

    return deduce


def repair(initials: list[str], faults: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    return lightest([((0, ""), (0, 0))], _spans(initials, faults, True), 1)[len(initials) + 1, 0]


def ways(initials: list[str], faults: str, entries=(0, 1, 2, 3)) -> list[tuple[int, int, int, str]]:
    """(state entered in, state left in, cost, audit) of the lightest ways through a run."""
    found = []
    for entry in entries:
        # state 0 is never entered again, and 1 only from it
        reachable = {0: 4, 1: 3, 2: 2, 3: 2}[entry]
        chart = lightest([((0, ""), (0, entry))], _spans(initials, faults, False), reachable)
        found += [(entry, item[1], *weight) for item, weight in chart.items() if item[0] == len(initials) + 1]
    return found


def join_ways(runs: list[list[tuple[int, int, int, str]]]) -> list[str]:
    """The audits of a conversation's runs, from the tables of ways through each, in order."""
    best: dict[int, tuple[int, str, list[str]]] = {0: (0, "", [])}
    for table_ in runs:
        after: dict[int, tuple[int, str, list[str]]] = {}
        for entry, left, cost, audit in table_:
            if entry in best:
                before = best[entry]
                found = (before[0] + cost, before[1] + audit)
                if left not in after or found < after[left][:2]:
                    after[left] = (*found, [*before[2], audit])
        best = after
    return min(best[q] for q in ACCEPT if q in best)[2]


def replay(roles: list[str], texts: list[str], faults: str, audit: str, state: int = 0):
    """(cost, state after, repaired roles, repaired texts) of an audit of a run."""
    cost, i, out_roles, out_texts = 0, 0, [], []
    for letter in audit:
        if letter == "D":
            cost += DELETE
        elif letter == "I":
            cost += INSERT
            out_roles.append(ROLE[state])
            out_texts.append("")
        else:
            role = roles[i] if letter == "K" else ROLE[state]
            cost += (KEEP if letter == "K" else REROLE) + (TRUNCATED if faults[i] == "t" else 0)
            out_roles.append(role)
            out_texts.append(texts[i])
        if letter != "D":
            state = STEP[state, out_roles[-1][0]]
        i += letter != "I"
    return cost, state, out_roles, out_texts


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults, put into (conv_id, turn, role, text) by CRC-32 of ``conv_id:turn``."""
    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    rows = rows.select(col("conv_id"), col("turn"), shown(F.col("role")).alias("role"), shown(F.col("text")).alias("text"))
    case = F.crc32(F.concat(shown(F.col("conv_id")), F.lit(":"), shown(F.col("turn"))).cast("binary")) % 20
    hit = rows.withColumn("_case", case).filter("_case != 0")
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return hit.select("conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
                      text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_case") == 3, 2).otherwise(1))).alias("_n")
                      ).drop("_n")


_RUNS = ("conv_id {kind}, run long, alone boolean, roles array<string>, texts array<string>, faults string, "
         "turns array<long>, ways array<struct<entry:int,left:int,cost:long,audit:string>>")


def _cut_runs(run_rows: int, run_bytes: int, schema: pa.Schema):
    """Runs of a task's sorted rows."""
    def cut(batches):
        from pyspark import TaskContext

        first_id = TaskContext.get().partitionId() << 33
        seq, conv, started, held = 0, None, False, None
        whole_start = False  # the run began with its conversation

        def new():
            return {"roles": [], "texts": [], "faults": [], "size": 0, "turns": None}

        def close(at_end: bool):
            """The run as a row; ``at_end``: its conversation is known to end with it."""
            nonlocal seq
            initials, faults = [r[:1] for r in held["roles"]], "".join(held["faults"])
            alone = whole_start and at_end
            if alone:
                table_ = [(0, 0, *repair(initials, faults))]
            else:
                table_ = ways(initials, faults, (0,) if whole_start else (0, 1, 2, 3))
            seq += 1
            return {"conv_id": conv, "run": first_id + seq, "alone": alone, "roles": held["roles"], "texts": held["texts"],
                    "faults": faults, "turns": held["turns"],
                    "ways": [dict(zip(("entry", "left", "cost", "audit"), w)) for w in table_]}

        out: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if held is None or r["conv_id"] != conv:
                    if held is not None:
                        out.append(close(True))
                    conv, held, whole_start = r["conv_id"], new(), started
                    started = True
                for k in range(r["copies"]):
                    if len(held["roles"]) >= run_rows or held["size"] >= run_bytes:
                        out.append(close(False))
                        held, whole_start = new(), False
                    held["roles"].append(r["role"])
                    held["texts"].append(r["text"])
                    held["faults"].append("b" if r["blank"] else "d" if k or not r["first"] else "t" if r["cut"] else "-")
                    held["size"] += len(r["text"])
                    size += len(r["text"])
                    if r["turn"] is not None:  # least, largest, number of different turns
                        turns = held["turns"] or [r["turn"], None, 0]
                        held["turns"] = [turns[0], r["turn"], turns[2] + (r["turn"] != turns[1])]
                    if len(out) >= 2000 or size >= 2 * run_bytes:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
        if held is not None:
            out.append(close(False))
        yield pa.RecordBatch.from_pylist(out, schema)

    return cut


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Runs of the conversations of ``rows`` (conv_id, turn, role, text), written; in order by ``run``."""
    spark = rows.sparkSession
    bound_batches(spark)
    kind = rows.schema["conv_id"].dataType
    trimmed = F.rtrim("text", F.lit(BLANKS))
    # equal rows are counted, then the first turn of each (conversation, role, text) is joined back on the turn too:
    # neither a hot conversation nor a text that it repeats is ever held by one task
    same = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).groupBy(
        "conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = same.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("p")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("p.turn").alias("t"))
    at_first = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
                & F.col("turn").eqNullSafe(F.col("t")))
    marked = same.join(firsts.hint("merge"), at_first, "left").select(
        "conv_id", "turn", "role", "digest", "text", "copies", F.col("d").isNotNull().alias("first"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    ranged = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("digest")
    ddl = _RUNS.format(kind=kind.simpleString())
    return materialize(ranged.mapInArrow(_cut_runs(RUN, RUN_BYTES, to_arrow_schema(T.StructType.fromDDL(ddl))), ddl))


def _join_runs(pdf):
    """Audits of the runs of one conversation, and the states they are entered in."""
    import pandas as pd

    pdf = pdf.sort_values("run")
    audits = join_ways([[(w["entry"], w["left"], w["cost"], w["audit"]) for w in ways_] for ways_ in pdf["ways"]])
    return pd.DataFrame({"id": pdf["run"].to_numpy(), "audit": audits})


_REPAIRED = ("conv_id {kind}, run long, initials string, faults string, turns array<long>, audit string, cost long, "
             "roles array<string>, texts array<string>")


def _replay_stream(schema: pa.Schema):
    """Repairs the runs of a task, sorted by run within conversations; the state is carried over from run to run."""
    def run(batches):
        conv, state, seen = None, 0, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not seen or r["conv_id"] != conv:
                    conv, state, seen = r["conv_id"], 0, True
                cost, state, roles, texts = replay(r["roles"], r["texts"], r["faults"], r["audit"], state)
                # one character a row: the initial, a space for an empty role
                initials = "".join(x[:1] or " " for x in r["roles"])
                out.append({"conv_id": conv, "run": r["run"], "initials": initials, "faults": r["faults"], "turns": r["turns"],
                            "audit": r["audit"], "cost": cost, "roles": roles, "texts": texts})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text) in runs.

    (conv_id, run, initials, faults, turns, audit, cost, roles, texts): the
    role initials and faults of a run's rows (one character each), its least
    and largest turn and number of different turns, the edits, their cost, and
    the repaired roles and texts.  The rows of a task are sorted by
    conversation and run, and a conversation is in one task.
    """
    runs = sorted_runs(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    whole = runs.filter("alone").withColumn("audit", F.col("ways")[0]["audit"]).drop("alone", "ways")
    cut = runs.filter("not alone")
    audits = cut.select("conv_id", "run", "ways").groupBy("conv_id").applyInPandas(_join_runs, "id long, audit string")
    joined = cut.join(audits.hint("merge"), F.col("run") == F.col("id")).drop("alone", "ways", "id")
    ddl = _REPAIRED.format(kind=kind)
    ordered = whole.unionByName(joined).repartition("conv_id").sortWithinPartitions("conv_id", "run")
    return ordered.mapInArrow(_replay_stream(to_arrow_schema(T.StructType.fromDDL(ddl))), ddl)


_SUMMARY = ("conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")
LEGAL = ("su", "ua", "au")


def _summarise(schema: pa.Schema):
    """One row a conversation from its runs, which come one after the other."""
    def run(batches):
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now["conv_id"]:
                    if now is not None:
                        out.append(finish(now))
                    now = {"conv_id": r["conv_id"], "turns": None, "last": "", "illegal": 0, "cost": 0, "audit": [],
                           "faults": {"b": 0, "d": 0, "t": 0}, "hash": hashlib.sha256(), "any": False}
                initials = now["last"] + r["initials"]
                now["illegal"] += sum(initials[k:k + 2] not in LEGAL for k in range(len(initials) - 1))
                now["last"] = initials[-1:]
                for f in now["faults"]:
                    now["faults"][f] += r["faults"].count(f)
                if r["turns"] is not None:
                    least, most, n = r["turns"]
                    before = now["turns"] or (least, None, 0)
                    now["turns"] = (before[0], most, before[2] + n - (before[1] == least))
                now["cost"] += r["cost"]
                now["audit"].append(r["audit"])
                for role, text in zip(r["roles"], r["texts"]):
                    now["hash"].update((("\n" if now["any"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    now["any"] = True
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([finish(now)], schema)

    def finish(now: dict) -> dict:
        least, most, n = now["turns"] or (0, -1, 0)
        return {"conv_id": now["conv_id"], "gaps": most - least + 1 - n, "blank": now["faults"]["b"],
                "duplicate": now["faults"]["d"], "truncated": now["faults"]["t"], "illegal": now["illegal"],
                "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

    return run


def summaries(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of each conversation that has rows."""
    ddl = _SUMMARY.format(kind=rows.schema["conv_id"].dataType.simpleString())
    return repair_conversations(rows).mapInArrow(_summarise(to_arrow_schema(T.StructType.fromDDL(ddl))), ddl)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = summaries(damage(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct()
    joined = every.join(found.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    empty = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.fillna(empty | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()},
                         [*empty, "audit", "repaired_sha256"])
