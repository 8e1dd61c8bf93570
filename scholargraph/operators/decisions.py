"""Decision logs: what a sequence of identity and review decisions leaves standing.

Logs are append-only rows with a sequence number; the state of a mention, an author or a subject is a window over its
own rows, so a log of any length is folded in parallel by key.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholargraph.operators.lineage import staged

#: Changes of locks, and authors that have any, which may go to every task (8 bytes a change).
LOCKS, LOCKED_AUTHORS = 8_000_000, 200_000

#: Decisions that give a mention an author, and those that take it away.
GIVES, TAKES = ("ACCEPT", "CREATE", "SPLIT"), ("UNLINK",)


def _as_of(log: DataFrame, events: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """`log` with the `value` of the last of events(seq, key, value) that comes before each row, of the same key."""
    both = log.withColumn("__event", F.lit(False)).unionByName(events.withColumn("__event", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn(name, F.last(F.when(F.col("__event"), F.col(value)), ignorenulls=True).over(w))
    return seen.filter(~F.col("__event")).select(*log.columns, name)


def new_author(seq: str = "seq", mention: str = "mention"):
    """The id of an author that a decision makes: it follows from the mention and the decision alone."""
    return F.concat(F.lit("a"), F.substring(F.sha2(F.concat_ws("|", F.col(mention).cast("string"), F.col(seq).cast("string")), 256), 1, 16))


def _outcome() -> tuple[Column, Column]:
    """(reason, moves) of a decision, from what its author's lock, its bar, and the author held at the moment say."""
    op, same = F.col("op"), F.col("target").eqNullSafe(F.col("held"))
    linking = (
        F.when(same, F.lit(None)).when(F.col("was_locked"), "LOCKED").when(F.col("was_barred") & (F.col("actor") != "MANUAL"), "NOT_SAME")
        .when(F.col("held_locked"), "HELD_LOCKED"))
    leaving = F.when((op == "SPLIT") & F.col("held").isNull(), "NOTHING_HELD").when(F.col("held_locked"), "HELD_LOCKED")
    reason = F.when(op == "ACCEPT", linking).when(op.isin("SPLIT", *TAKES), leaving)
    idle = ((op == "ACCEPT") & same) | ((op == "CREATE") & F.col("held").isNotNull()) | (op.isin(*TAKES) & F.col("held").isNull())
    return reason, F.coalesce(op.isin(*GIVES, *TAKES) & reason.isNull() & ~idle, F.lit(False))


def judged_log(log: DataFrame) -> DataFrame:
    """log(seq, op, mention, author, actor) with `target` (the author a row gives), `held` (the author its mention has
    at that moment), `outcome`, `reason`, and whether it `moves` the mention.

    ACCEPT links a mention to an author, CREATE to a new one if it has none, SPLIT from its author to a new one, UNLINK
    to none; NOT_SAME rules an author out for a mention, LOCK and UNLOCK close and open an author. REFUSED are: links to
    an author who is LOCKED, or whom NOT_SAME rules out unless the actor is MANUAL; any move off a held author who is
    locked (HELD_LOCKED); SPLIT of a mention without an author (NOTHING_HELD). A link to the author held already, and
    UNLINK where none is held, change nothing and are never refused.

    What a mention holds depends on the outcomes of its earlier rows, and these on the locks of what it held then. Locks
    follow from the log alone. If their changes are few enough to go to every task, each mention's rows are judged one
    after the other as they stream by, sorted; beyond that, all rows are judged at once in rounds (`_in_rounds`). Neither
    gathers rows by mention or author; a task keeps the authors ruled out for the mention at hand.
    """
    target = F.when(F.col("op").isin("CREATE", "SPLIT"), new_author()).when(~F.col("op").isin(*TAKES), F.col("author").cast("string"))
    rows = staged(log, "log").withColumn("target", target)
    locks = rows.filter(F.col("op").isin("LOCK", "UNLOCK")).select("seq", F.col("target").alias("held"), (F.col("op") == "LOCK").alias("locked"))
    was = F.coalesce(F.lag("locked").over(Window.partitionBy("held").orderBy("seq")), F.lit(False))
    changes = staged(locks.withColumn("was", was).filter("was <> locked").select("held", "seq"), "locks")
    size = changes.groupBy("held").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("authors"), F.coalesce(F.sum("n"), F.lit(0)).alias("changes")).first()
    judged = _in_turn(rows, changes) if size["changes"] <= LOCKS and size["authors"] <= LOCKED_AUTHORS else _in_rounds(rows, locks)
    return judged.select(*log.columns, "target", "held", F.when(F.col("reason").isNull(), "DONE").otherwise("REFUSED").alias("outcome"), "reason", "moves")


def _in_turn(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with held, reason and moves: one pass over each mention's rows in their order. An author is locked if the number
    of changes(held, seq) before a row is odd."""
    got = changes.toArrow()
    at, names = got.column("seq").to_numpy(), got.column("held").combine_chunks().dictionary_encode()
    order = np.lexsort((at, codes := names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)))
    ends = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 2))
    at, authors = at[order].astype(np.int64), [*names.dictionary.to_pylist(), None]
    sent = rows.sparkSession.sparkContext.broadcast({a: array("q", at[i:j].tobytes()) for a, i, j in zip(authors, ends, ends[1:]) if i < j})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        locks = sent.value
        now, held, barred = object(), None, set()

        def locked(author, seq) -> bool:
            found = locks.get(author)
            return found is not None and bisect_left(found, seq) & 1

        for b in batches:
            helds, reasons, moved = [], [], []
            for m, seq, op, author, actor in zip(*(b.column(c).to_pylist() for c in ("mention", "seq", "op", "target", "actor"))):
                if m != now:
                    now, held, barred = m, None, set()
                had, reason, moves = held, None, False
                if op == "ACCEPT":
                    if author != had:
                        if locked(author, seq):
                            reason = "LOCKED"
                        elif author in barred and actor is not None and actor != "MANUAL":
                            reason = "NOT_SAME"
                        elif had is not None and locked(had, seq):
                            reason = "HELD_LOCKED"
                        else:
                            moves = True
                elif op == "CREATE":
                    moves = had is None
                elif op == "SPLIT" or op == "UNLINK":
                    if had is None:
                        reason = "NOTHING_HELD" if op == "SPLIT" else None
                    elif locked(had, seq):
                        reason = "HELD_LOCKED"
                    else:
                        moves = True
                elif op == "NOT_SAME":
                    barred.add(author)
                if moves:
                    held = author
                helds.append(had)
                reasons.append(reason)
                moved.append(moves)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(helds, pa.string()), pa.array(reasons, pa.string()), pa.array(moved, pa.bool_())], names=[*b.schema.names, "held", "reason", "moves"])

    schema = T.StructType([*rows.schema.fields, T.StructField("held", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("moves", T.BooleanType())])
    return rows.repartition("mention").sortWithinPartitions("mention", "seq").mapInArrow(judge, schema)


def _in_rounds(rows: DataFrame, locks: DataFrame) -> DataFrame:
    """rows with held, reason and moves: all are judged at once from the outcomes of the round before, until a round changes
    none. A round settles at least the next row of every mention; rows after a wrong one are right as soon as both lead to
    one author, so rounds are as many as the longest run of rows that truly hang on each other, not as many as a mention has
    rows. Each step is a window over sorted rows."""
    bars = rows.filter("op = 'NOT_SAME'").select("seq", "mention", "target", F.lit(True).alias("barred"))
    seen = _as_of(rows, locks.withColumnRenamed("held", "target"), ["target"], "locked", "was_locked")
    seen = staged(_as_of(seen, bars, ["mention", "target"], "barred", "was_barred").withColumn("moves", F.col("op").isin(*GIVES, *TAKES)), "decisions")
    before = Window.partitionBy("mention").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        moved = F.when(F.col("moves"), F.struct(F.when(F.col("op").isin(*GIVES), F.col("target")).alias("author")))
        holding = seen.withColumn("held", F.last(moved, ignorenulls=True).over(before)["author"])
        held = _as_of(holding, locks, ["held"], "locked", "held_locked")
        reason, moves = _outcome()
        now = staged(held.withColumn("reason", reason).withColumn("moves_", moves), "decisions")
        if now.filter("moves <> moves_").isEmpty():
            return now
        seen = now.drop("held", "held_locked", "reason", "moves").withColumnRenamed("moves_", "moves")


def memberships(log: DataFrame) -> DataFrame:
    """seq, mention, author, status, until of every link that the log makes: ACCEPTED for the one in force, SUPERSEDED
    (with the seq that ended it) for the others. Refused rows change nothing, nor do those that do not move a mention."""
    w = Window.partitionBy("mention").orderBy("seq")
    spans = judged_log(log).filter("moves").withColumn("until", F.lead("seq").over(w)).filter(F.col("op").isin(*GIVES))
    return spans.select("seq", "mention", F.col("target").alias("author"), F.when(F.col("until").isNull(), "ACCEPTED").otherwise("SUPERSEDED").alias("status"), "until")


def not_same_pairs(log: DataFrame) -> DataFrame:
    """left_id, right_id: authors judged not to be one, each pair once whatever its order; log(author, other)."""
    return log.filter("author <> other").select(F.least("author", "other").alias("left_id"), F.greatest("author", "other").alias("right_id")).distinct()


def review_queue(log: DataFrame) -> DataFrame:
    """subject, status, priority, opened, closed of log(seq, subject, op, priority).

    ENQUEUE opens a subject's item, or raises the priority of an open one (the highest counts); RESOLVE and DISMISS
    close it; a later ENQUEUE opens a new one. The last item of every subject is returned.
    """
    w = Window.partitionBy("subject").orderBy("seq")
    closing = F.col("op").isin("RESOLVE", "DISMISS")
    part = log.withColumn("item", F.coalesce(F.sum(closing.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opened = F.when(F.col("op") == "ENQUEUE", F.col("seq"))
    items = part.groupBy("subject", "item").agg(
        F.min(opened).alias("opened"), F.max(F.when(F.col("op") == "ENQUEUE", F.col("priority"))).alias("priority"),
        F.max(F.when(closing, F.struct("seq", "op"))).alias("end")).filter("opened is not null")
    last = items.groupBy("subject").agg(F.max_by(F.struct("opened", "priority", "end"), "item").alias("i"))
    status = F.when(F.col("i.end").isNull(), "OPEN").when(F.col("i.end.op") == "RESOLVE", "RESOLVED").otherwise("DISMISSED")
    return last.select("subject", status.alias("status"), "i.priority", "i.opened", F.col("i.end.seq").alias("closed"))


def link_guard(wanted: DataFrame, accepted: DataFrame, papers: DataFrame) -> DataFrame:
    """wanted(mention, author) with `allowed`: no other mention of the mention's paper (papers(mention, paper)) may have
    the author already (accepted(mention, author))."""
    taken = accepted.join(papers, "mention").select("author", "paper", F.col("mention").alias("holder"))
    asked = wanted.join(papers, "mention")
    clash = asked.join(taken, ["author", "paper"]).filter("holder <> mention").select("mention", "author").distinct().withColumn("clash", F.lit(True))
    return asked.join(clash, ["mention", "author"], "left").select("mention", "author", F.col("clash").isNull().alias("allowed"))


def anchors(accepted: DataFrame, mentions: DataFrame) -> DataFrame:
    """author, creators (source creators of its mentions), stable_key (its smallest mention), names: of
    accepted(mention, author) and mentions(mention, creator, name)."""
    return accepted.join(mentions, "mention").groupBy("author").agg(
        F.array_sort(F.collect_set("creator")).alias("creators"), F.min("mention").alias("stable_key"), F.array_sort(F.collect_set("name")).alias("names"))


def authors_of_name(accepted: DataFrame, mentions: DataFrame) -> DataFrame:
    """name, authors: the authors that any mention of a name belongs to."""
    return accepted.join(mentions, "mention").groupBy("name").agg(F.array_sort(F.collect_set("author")).alias("authors"))


def active_authorships(accepted: DataFrame, mentions: DataFrame) -> DataFrame:
    """paper, mention, author: one authorship for each mention in force, from memberships() and mentions(mention, paper)."""
    return accepted.filter("status = 'ACCEPTED'").join(mentions.select("mention", "paper"), "mention").select("paper", "mention", "author")
