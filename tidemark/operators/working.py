"""Working memory: token budgets, trimming, pressure, rendering; set-based per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, tokens


def messages(episodes: DataFrame) -> DataFrame:
    """The lines of raw episodes as messages of the day's conversation: ``conv_id``, ``seq``, ``role``, ``text``, ``tokens``.

    A line's role is given by ``user: `` or ``assistant: `` at its start, else it is system.
    """
    rows = episodes.where("level = 0 and occurred_at is not null").select(F.date_format("occurred_at", "yyyy-MM-dd").alias("conv_id"), "occurred_at", "id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    role = F.when(F.col("line").startswith("user: "), "user").when(F.col("line").startswith("assistant: "), "assistant").otherwise("system")
    text = F.when(role == "user", F.substring("line", 7, 1 << 30)).when(role == "assistant", F.substring("line", 12, 1 << 30)).otherwise(F.col("line"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("occurred_at", "id", "at")).cast("long")
    out = rows.select("conv_id", seq.alias("seq"), "id", role.alias("role"), text.alias("text"))
    return out.withColumn("tokens", tokens(F.concat("role", F.lit(": "), "text")))


def utilization(msgs: DataFrame, budget: int, pressure: float = 0.8) -> DataFrame:
    used = F.sum("tokens")
    return msgs.groupBy("conv_id").agg(used.alias("tokens"), F.round(used / budget, 6).alias("utilization"), (used / budget >= pressure).alias("under_pressure"))


def trim(msgs: DataFrame, budget: int, pressure: float = 0.8, keep: float = 0.9) -> DataFrame:
    """The newest messages within the budget, one at least, per conversation: a suffix sum."""
    limit = int(budget * pressure * keep)
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    return msgs.withColumn("after", F.sum("tokens").over(w)).withColumn("newest", F.row_number().over(w) == 1).where((F.col("after") <= limit) | F.col("newest")).drop("after", "newest")


def offload_candidates(msgs: DataFrame, keep: int = 2, relevance: float = 0.5) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    old = msgs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > keep)
    return old.select("conv_id", "seq", F.concat("role", F.lit(": "), "text").alias("content"), F.lit(relevance).alias("relevance"))


def pressure_plan(msgs: DataFrame, retrieved: DataFrame, task_tokens: int, budget: int, pressure: float = 0.8) -> DataFrame:
    """What is evicted, in stages: retrieved items, then all but the last two messages (summarised), then the task.

    retrieved: ``conv_id``, ``tokens``.  A summary costs a quarter of 50 characters per message it replaces.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    ranked = msgs.withColumn("rank", F.row_number().over(w))
    own = ranked.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("dialog"), F.sum(F.when(F.col("rank") <= 2, F.col("tokens")).otherwise(0)).alias("last_two"))
    extra = retrieved.groupBy("conv_id").agg(F.sum("tokens").alias("extra"))
    x = own.join(extra, "conv_id", "left").withColumn("extra", F.coalesce("extra", F.lit(0)).cast("long"))
    line = pressure * budget
    total = F.col("dialog") + F.col("extra") + task_tokens
    without = F.col("dialog") + task_tokens
    short = F.col("last_two") + 12 * (F.col("n") - 2)
    one, two = total >= line, (total >= line) & (without >= line) & (F.col("n") > 2)
    after_two = F.when(two, short + task_tokens).otherwise(without)
    three = one & (after_two >= line)
    left = F.when(~one, total).when(three, after_two - task_tokens).otherwise(after_two)
    return x.select("conv_id", total.cast("long").alias("tokens_before"), one.alias("clear_retrieved"), two.alias("summarise"), three.alias("evict_task"), left.cast("long").alias("tokens_after"))


def render(items: DataFrame) -> DataFrame:
    """``conv_id``, ``context``: all items (``conv_id``, ``id``, ``text``, ``relevance``), most relevant first."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "id", "text"))), lambda s: F.concat(F.lit("- "), s["text"]))
    return items.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("context"))


def render_sections(context: DataFrame, memories: DataFrame, msgs: DataFrame) -> DataFrame:
    """``conv_id``, ``rendered``: the prompt's sections in fixed order, those that are empty left out.

    context: one row per conversation with ``conv_id``, ``system`` and ``task``; memories: ``conv_id``, ``id``,
    ``text``, ``source``, ``relevance``; msgs as :func:`messages` gives them.  A conversation fits a
    prompt, so its lines are gathered into one text.
    """
    said = F.transform(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))), lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["text"]))
    dialog = msgs.groupBy("conv_id").agg(F.array_join(said, "\n").alias("dialog"))
    by_relevance = F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "id", "text", "source")))
    lines = F.transform(by_relevance, lambda m: F.concat(F.lit("- "), m["text"], F.lit(" (from "), m["source"], F.lit(")")))
    found = memories.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("memories"))
    joined = context.join(found, "conv_id", "left").join(dialog, "conv_id", "left")
    sections = [("System Context", "system"), ("Current Task", "task"), ("Relevant Memories", "memories"), ("Conversation History", "dialog")]
    parts = [F.concat(F.lit(f"# {title}\n"), blank_to_null(c)) for title, c in sections]
    return joined.select("conv_id", F.concat_ws("\n\n", *parts).alias("rendered"))


def offload_items(context: DataFrame, memories: DataFrame, msgs: DataFrame, keep: int = 2) -> DataFrame:
    """All that may leave working memory: ``conv_id``, ``source``, ``content``, ``relevance``, ``priority`` (0 goes first).

    Retrieved items, then messages but the last ``keep``, then the task; the system text never goes.
    """
    zero = memories.select("conv_id", "source", F.col("text").alias("content"), F.col("relevance").cast("double").alias("relevance"), F.lit(0).alias("priority"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    old = msgs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep)
    one = old.select("conv_id", F.concat(F.lit("dialog_"), "role").alias("source"), F.col("text").alias("content"), F.lit(0.5).alias("relevance"), F.lit(1).alias("priority"))
    task = context.where("task is not null and task <> ''").select("conv_id", F.lit("task_context").alias("source"), F.col("task").alias("content"), F.lit(0.6).alias("relevance"), F.lit(2).alias("priority"))
    return zero.unionByName(one).unionByName(task)


def prompt_messages(rendered: DataFrame, msgs: DataFrame) -> DataFrame:
    """``conv_id``, ``at``, ``role``, ``content``: the rendered context as system message, earlier turns, and the last message as the user's."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    last = F.row_number().over(w) == 1
    turns = msgs.select("conv_id", "seq", F.when(last, F.lit("user")).otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    head = rendered.select("conv_id", F.lit(0).cast("long").alias("seq"), F.lit("system").alias("role"), F.col("rendered").alias("content"))
    return head.unionByName(turns).withColumnRenamed("seq", "at")


def set_context(context: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Sets ``system`` or ``task`` of conversations (changes: ``conv_id``, ``value``); a null value clears it, new conversations are added."""
    new = changes.groupBy("conv_id").agg(F.max("value").alias("_value"), F.lit(True).alias("_set"))
    joined = context.join(new, "conv_id", "full")
    return joined.withColumn(column, F.when(F.col("_set"), F.col("_value")).otherwise(F.col(column))).select(*context.columns)


def cleared(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages or retrieved items without those of the cleared conversations."""
    return rows.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")


def interaction_pairs(msgs: DataFrame) -> DataFrame:
    """User messages that an assistant message follows directly."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    nxt = msgs.select("conv_id", "seq", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "seq", F.col("text").alias("question"), "answer")
