"""From ban records to firewall rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakguard.operators.bans import unexpired
from leakguard.operators.cidr import minimal_prefixes

def _ports(dst_ports) -> Column:
    return F.array(*[F.lit(p) for p in dst_ports]).cast("array<int>")


def rule_entries(minimal: DataFrame, dst_ports=(80, 443)) -> DataFrame:
    """The rule as one row per prefix: ``family, lo, prefix, dst_ports``.

    Address order is ``(family, lo)``.  This form has no group, whatever its size.
    """
    return minimal.select("family", "lo", "prefix", _ports(dst_ports).alias("dst_ports"))


def assemble_rules(minimal: DataFrame, dst_ports=(80, 443)) -> DataFrame:
    """One rule with all prefixes in address order: ``prefixes, dst_ports``.

    An empty set gives a rule without prefixes.  The rule is one row, so all its
    prefixes pass through one task; ``rule_entries`` is the form for sets too large
    for a row.
    """
    order = F.array_sort(F.collect_list(F.struct("family", "lo", "prefix")))
    # a global aggregate keeps its single row when there is nothing to list
    rules = minimal.agg(F.transform(order, lambda p: p["prefix"]).alias("prefixes"))
    return rules.select("prefixes", _ports(dst_ports).alias("dst_ports"))


def compile_rules(bans: DataFrame, now, dst_ports=(80, 443)) -> DataFrame:
    """Unexpired bans -> one rule ``prefixes, dst_ports``."""
    return assemble_rules(minimal_prefixes(unexpired(bans, now)), dst_ports)


def compile_entries(bans: DataFrame, now, dst_ports=(80, 443)) -> DataFrame:
    """Unexpired bans -> the rule's prefixes, a row each (see ``rule_entries``)."""
    return rule_entries(minimal_prefixes(unexpired(bans, now)), dst_ports)


def rules_json(rules: DataFrame) -> DataFrame:
    """One JSON text per rule."""
    return rules.select(F.to_json(F.struct("prefixes", "dst_ports")).alias("rule"))


def write_rules(rules: DataFrame, path: str) -> None:
    rules.select("prefixes", "dst_ports").write.mode("overwrite").json(path)
