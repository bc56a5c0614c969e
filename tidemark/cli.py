"""Commands on a store: ``python -m tidemark.cli --store DIR COMMAND``.

chat TEXT        retrieves, answers through a judge (by default the prompt itself) and stores the turn
query TEXT       facts and episodes near a text
consolidate      runs a cycle if one is due (``--force``: anyway)
status           counts of every kind
export DIR       all tables as JSON, with statistics
reset --force    empties all tables
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.models import Judge
from tidemark.operators import consolidation as K
from tidemark.operators import ingest as I
from tidemark.operators import retrieval as R
from tidemark.operators import search as Q
from tidemark.operators import working as W
from tidemark.sources.store import Store


def retrieve(store: Store, text: str, at: str, k: int = 10) -> DataFrame:
    """The context items of a text: ``source``, ``id``, ``text``, ``relevance``."""
    found = Q.hybrid_query(store, text, at, k)
    names = store.read("entities").select("id", "name")
    facts, episodes = found["facts"], found["episodes"]
    return R.fact_items(facts.drop("score", "rank"), names, facts.select("id", "score")).unionByName(R.episode_items(episodes.drop("score", "final"), episodes.select("id", F.col("final").alias("score"))))


def chat(store: Store, text: str, at: str, history: list[tuple[str, str]] | None = None, judge: Judge | None = None, system: str = "") -> str:
    """One turn: retrieve, put the prompt together, answer, store the interaction."""
    spark = store.spark
    turns = [(1 + i, role, said) for i, (role, said) in enumerate([*(history or []), ("user", text)])]
    msgs = spark.createDataFrame([("chat", *t) for t in turns], "conv_id string, seq long, role string, text string")
    context = spark.createDataFrame([("chat", system, None)], "conv_id string, system string, task string")
    memories = retrieve(store, text, at).withColumn("conv_id", F.lit("chat"))
    prompt = W.prompt_messages(W.render_sections(context, memories, msgs), msgs).orderBy("at").collect()  # one conversation
    asked = "\n".join(f"{m.role}: {m.content}" for m in prompt)
    answer = judge.answer([asked])[0] if judge else asked
    turn = spark.createDataFrame([("chat", len(turns), text, answer, dt.datetime.fromisoformat(at))], "conv_id string, seq long, question string, answer string, at timestamp_ntz")
    I.ingest(store, turn)
    return answer


def consolidate(store: Store, now: str, force: bool = False) -> DataFrame | None:
    """The report of a cycle, or None where none is due."""
    due = force or K.should_run(store.read("episodes"), None, now).first().due
    return I.run_cycle(store, now) if due else None


def status(store: Store) -> DataFrame:
    """``what``, ``n``: rows of every table, and episodes by level."""
    out = store.read("episodes").groupBy("level").agg(F.count("*").alias("n")).select(F.concat(F.lit("episodes_L"), F.col("level").cast("string")).alias("what"), "n")
    for name in store.tables():
        out = out.unionByName(store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--store", required=True)
    p.add_argument("--now", default=dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds"))
    p.add_argument("command", choices=["chat", "query", "consolidate", "status", "export", "reset"])
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--force", action="store_true")
    own = p.parse_args(args)
    store = I.open_store(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), own.store)
    if own.command == "chat":
        print(chat(store, own.argument, own.now))
    elif own.command == "query":
        retrieve(store, own.argument, own.now, own.limit).orderBy(F.desc("relevance"), "id").show(own.limit, truncate=80)
    elif own.command == "consolidate":
        report = consolidate(store, own.now, own.force)
        print("nothing to do") if report is None else report.show(truncate=False)
    elif own.command == "status":
        status(store).orderBy("what").show(100, truncate=False)
    elif own.command == "export":
        store.export_all(own.argument).show(100, truncate=False)
    elif not own.force:
        p.error("reset needs --force")
    else:
        store.reset_all()


if __name__ == "__main__":
    main()
