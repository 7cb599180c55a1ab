"""Column expressions over bounded lists, and keys of executions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def names_pattern(names: list[str]) -> str:
    """One pattern for all names, however many: a tree by their characters, longer names first."""
    tree: dict = {}
    for name in names:
        node = tree
        for c in name:
            node = node.setdefault(c, {})
        if name:
            node[""] = {}

    def written(node: dict) -> str:
        prefix = ""
        while len(node) == 1 and "" not in node:  # no fork: spare a group
            c, node = next(iter(node.items()))
            prefix += re.escape(c)
        forks = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        return prefix + (("(?:" + "|".join(forks) + ")" + ("?" if "" in node else "")) if forks else "")

    return written(tree) if tree else r"(?!)"


def dictionary_hits(text: Column, names: list[str]) -> Column:
    """Names in the text, left to right, without overlaps; of several at a place the longest."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(names_pattern(names)), F.lit(0))


def execution_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each ended by a zero byte; a null part counts as empty."""
    ended = [F.concat(F.encode(F.coalesce(p.cast("string"), F.lit("")), "UTF-8"), F.unhex(F.lit("00"))) for p in parts]
    return F.sha2(reduce(lambda a, b: F.concat(a, b), ended), 256)


def execution_state(decision: Column, exit_code: Column, timed_out: Column) -> Column:
    """executed, failed or timeout of what ran; not_run where the decision was no approval."""
    return (
        F.when(F.coalesce(decision, F.lit("")) != "approved", "not_run").when(F.coalesce(timed_out, F.lit(False)), "timeout").when(exit_code == 0, "executed").otherwise("failed")
    )
