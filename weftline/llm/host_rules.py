"""Quality rules judged by host, with DataFrame functions only.

Each text is measured, the failures of every rule are counted by host, the
hosts' rates are shrunk by an empirical beta prior, and the hosts' verdicts are
joined back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, join_facts

#: Words are runs of other characters than these.
SPACE = r"[ \t-\r]+"
SYMBOLS = "[#*$%&|<>]"
#: Rules over the measures; a document that fails a rule of DOCUMENT is out by itself.
DOCUMENT = {"short": "n_words < 50", "repeated": "100 * n_repeat_words > 50 * n_words"}
#: Rules that count for the host alone.
HOST = {"symbols": "10 * n_symbols > word_chars", "lines": "10 * n_dup_lines > 3 * n_lines"}
#: A host is out if the shrunk rate of one rule is above this.
HOST_LIMIT = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _covered(starts: Column, width: int) -> Column:
    """Places that windows of width places, given their sorted starts, cover."""
    first = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(width), s - acc["last"])).alias("n"))
    return F.aggregate(starts, first, step, lambda acc: acc["n"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and MEASURES (long) of every whole text.

    A null or empty text has zeros. n_lines counts lines with a word, n_dup_lines
    those equal to an earlier line. n_repeat_words counts words in windows of three
    words that the text holds twice or more. The windows of a text are sorted within
    its row, in time n log n; a text must fit in a task, as any Spark row must.
    Repeated rows and ids are measured each; other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    # every step refers more than once to what the one before computed, so Spark computes that once
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    window = lambda i: F.struct(F.concat_ws(" ", *(F.get("words", i + k) for k in range(3))).alias("words"), i.alias("at"))
    windows = F.when(F.size("words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)))
    sized = words.select(
        "doc_id",
        "host",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        windows.alias("windows"),
    )
    twice = F.filter("windows", lambda x, i: (x["words"] == F.get("windows", i - 1)["words"]) | (x["words"] == F.get("windows", i + 1)["words"]))
    repeated = _covered(F.sort_array(F.transform(twice, lambda x: x["at"])), 3)
    return sized.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0))).select("doc_id", "host", *(F.col(x).cast("long").alias(x) for x in MEASURES))


def beta_priors(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and strength (pseudo-documents) of the beta prior of each rule's failure rate, by moments over hosts with columns n and one count for each rule.

    The variance between hosts is the weighted variance of their rates less what
    binomial counts have anyway. Without such a variance the strength is infinite
    (every host has the mean); without hosts the mean is zero.
    """
    shares = [F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_squares") for r in rules]
    row = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), *(F.sum(r).alias(r) for r in rules), *shares).first()
    return {r: beta_prior(row.hosts, row.n or 0, row.squares or 0.0, row[r] or 0, row[f"{r}_squares"] or 0.0) for r in rules}


def beta_prior(hosts: int, n: int, n_squares: float, failed: int, rate_squares: float) -> tuple[float, float]:
    """Mean and strength from the sums over hosts of documents, their squares, failures, and failures squared by documents."""
    if hosts < 2 or not 0 < failed < n:
        return (failed / n if n else 0.0), float("inf")
    mean = failed / n
    within = mean * (1 - mean)
    between = (rate_squares - n * mean * mean - (hosts - 1) * within) / (n - n_squares / n)
    return mean, max(within / between - 1, 0.0) if between > 0 else float("inf")


def shrunk(failed: Column, n: Column, prior: tuple[float, float]) -> Column:
    """Failure rate of a host under a beta prior."""
    mean, strength = prior
    return F.lit(mean) if strength == float("inf") else (failed + F.lit(mean * strength)) / (n + F.lit(strength))


def judge_hosts(measured: DataFrame, rules: dict[str, str], limit: float = HOST_LIMIT) -> DataFrame:
    """host_key, n, failures and shrunk rate of each rule, host_kept: counts are summed before they are shuffled, so a host of a third of all rows costs what others cost."""
    scratch = Scratch(measured.sparkSession)
    counts = measured.groupBy("host_key").agg(F.count("*").alias("n"), *(F.count_if(F.expr(sql)).alias(r) for r, sql in rules.items()))
    hosts = scratch.write(counts)
    priors = beta_priors(hosts, list(rules))
    rates = {f"{r}_rate": shrunk(F.col(r), F.col("n"), priors[r]) for r in rules}
    return hosts.withColumns(rates).withColumn("host_kept", F.greatest(*rates, F.lit(0.0)) <= limit)


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", document: dict[str, str] | None = None, host: dict[str, str] | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, host, MEASURES, base_failed, host_n, the shrunk rate of each rule, host_kept, kept.

    A document is kept if it fails no rule of ``document`` and its host is kept; a
    host is out if one of its shrunk rates, of rules of either kind, is above limit
    (a rate equal to it is kept). Null hosts are one host. Other columns of docs,
    whatever their names, are not returned; repeated rows stay rows of their own and
    count each; an empty table gives no rows.
    """
    document = DOCUMENT if document is None else document
    rules = document | (HOST if host is None else host)
    scratch = Scratch(docs.sparkSession)
    # null keys meet nothing in a join, so hosts are told apart by whether they are null, too
    key = F.when(F.col("host").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("host").cast("string")))
    measured = scratch.write(measure(docs, id_col, text_col, host_col).withColumn("host_key", key))
    hosts = scratch.write(judge_hosts(measured, rules, limit))
    total = measured.count()
    failed = F.lit(False)
    for sql in document.values():
        failed = failed | F.expr(sql)
    joined = join_facts(measured, hosts.select("host_key", F.col("n"), *(f"{r}_rate" for r in rules), "host_kept"), "host_key", "n", total)
    return joined.select("doc_id", "host", *MEASURES, failed.alias("base_failed"), F.col("n").alias("host_n"), *(f"{r}_rate" for r in rules), "host_kept", (~failed & F.col("host_kept")).alias("kept"))
