"""Severity rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS

# Severity words of each system and the level they stand for.
LEVEL_TABLES: dict[str, dict[str, str]] = {
    "gcp": {
        "DEFAULT": "INFO",
        "DEBUG": "DEBUG",
        "INFO": "INFO",
        "NOTICE": "INFO",
        "WARNING": "WARNING",
        "ERROR": "ERROR",
        "CRITICAL": "CRITICAL",
        "ALERT": "CRITICAL",
        "EMERGENCY": "CRITICAL",
    },
    "azure": {
        "ERROR": "ERROR",
        "WARN": "WARNING",
        "WARNING": "WARNING",
        "INFO": "INFO",
        "INFORMATION": "INFO",
        "CRITICAL": "CRITICAL",
        "FATAL": "CRITICAL",
        "DEBUG": "DEBUG",
        "VERBOSE": "DEBUG",
    },
    "azure_number": {"0": "DEBUG", "1": "INFO", "2": "WARNING", "3": "ERROR", "4": "CRITICAL"},
    "apache": {
        "emerg": "CRITICAL",
        "alert": "CRITICAL",
        "crit": "CRITICAL",
        "error": "ERROR",
        "warn": "WARNING",
        "notice": "INFO",
        "info": "INFO",
        "debug": "DEBUG",
    },
    "json": {
        "FATAL": "CRITICAL",
        "ERR": "ERROR",
        "WARN": "WARNING",
        "INFORMATION": "INFO",
        "DBG": "DEBUG",
        "TRACE": "DEBUG",
    },
    "syslog": {
        "0": "CRITICAL",
        "1": "CRITICAL",
        "2": "CRITICAL",
        "3": "ERROR",
        "4": "WARNING",
        "5": "INFO",
        "6": "INFO",
        "7": "DEBUG",
    },
    "android": {"V": "DEBUG", "D": "DEBUG", "I": "INFO", "W": "WARNING", "E": "ERROR", "F": "CRITICAL"},
    "java": {"WARN": "WARNING", "FATAL": "CRITICAL"},
    "hdfs": {"WARN": "WARNING"},
    "supercomputer": {name: name for name in LEVELS},
    "windows": {"WARN": "WARNING", "WARNING": "WARNING", "ERROR": "ERROR"},
    "containerd": {
        "INFO": "INFO",
        "DEBUG": "DEBUG",
        "WARN": "WARNING",
        "WARNING": "WARNING",
        "ERROR": "ERROR",
        "CRITICAL": "CRITICAL",
    },
    "universal": {
        "FATAL": "CRITICAL",
        "CRITICAL": "CRITICAL",
        "CRIT": "CRITICAL",
        "ERROR": "ERROR",
        "ERR": "ERROR",
        "WARNING": "WARNING",
        "WARN": "WARNING",
        "INFO": "INFO",
        "DEBUG": "DEBUG",
        "DBG": "DEBUG",
        "TRACE": "DEBUG",
        "NOTICE": "INFO",
    },
}

# Words that give a level away, tested in this order, per kind of line.
KEYWORD_RULES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "message": (
        ("CRITICAL", ("fatal", "crit")),
        ("ERROR", ("err",)),
        ("WARNING", ("warn",)),
        ("INFO", ("info",)),
        ("DEBUG", ("debug",)),
    ),
    "bsd": (("ERROR", ("error", "fail", "denied")), ("WARNING", ("warn",)), ("DEBUG", ("debug",))),
    "thunderbird": (("ERROR", ("error", "fail")), ("WARNING", ("warn",))),
    "proxifier": (("ERROR", ("error", "fail")), ("DEBUG", ("close",))),
    "hpc": (("ERROR", ("unavailable", "error")), ("WARNING", ("warning",))),
    "squid": (("ERROR", ("/5", "ERR", "/4", "DENIED")),),
    "universal": (("ERROR", ("error", "fail", "exception")), ("WARNING", ("warn",)), ("DEBUG", ("debug",))),
}
_CASE_SENSITIVE_RULES = {"hpc", "squid"}


def is_error(level: Column) -> Column:
    return level.isin("ERROR", "CRITICAL")


def is_warning(level: Column) -> Column:
    return level == "WARNING"


def level_rank(level: Column) -> Column:
    """0 (DEBUG) .. 4 (CRITICAL); null for any other word."""
    rank = F.lit(None).cast("int")
    for position, name in reversed(list(enumerate(LEVELS))):
        rank = F.when(level == name, position).otherwise(rank)
    return rank


def map_level(word: Column, table: str, default: str | None = None) -> Column:
    """Look a severity word up; unknown words give ``default``, or stay as they are when it is None."""
    pairs = list(LEVEL_TABLES[table].items())
    known = F.when(word == pairs[0][0], pairs[0][1])
    for key, level in pairs[1:]:
        known = known.when(word == key, level)
    return known.otherwise(word if default is None else F.lit(default))


def infer_level(text: Column, rule: str, default: str | None = "INFO", folded: bool = False) -> Column:
    """Level from the first keyword group found in the text; ``folded`` text is already in lower case."""
    haystack = text if folded or rule in _CASE_SENSITIVE_RULES else F.lower(text)
    chain = None
    for level, words in KEYWORD_RULES[rule]:
        found = haystack.contains(words[0])
        for word in words[1:]:
            found = found | haystack.contains(word)
        chain = F.when(found, level) if chain is None else chain.when(found, level)
    return chain.otherwise(F.lit(default))


def level_from_message(message: Column, folded: bool = False) -> Column:
    """Level named anywhere in a message, most severe word first; null when none is."""
    return infer_level(message, "message", default=None, folded=folded)


def level_from_status(status: Column, policy: str = "plain") -> Column:
    """HTTP status -> level. ``plain``: below 400 is INFO. ``verbose``: below 300 is DEBUG."""
    code = F.coalesce(status.try_cast("int"), F.lit(2**31 - 1))
    chain = F.when(code >= 500, "ERROR").when(code >= 400, "WARNING")
    if policy == "verbose":
        return chain.when(code >= 300, "INFO").otherwise("DEBUG")
    if policy == "plain":
        return chain.otherwise("INFO")
    raise ValueError(f"unknown status policy: {policy}")


def status_category(status: Column) -> Column:
    hundred = F.floor(status.try_cast("int") / 100)
    return (
        F.when(hundred == 2, "Success")
        .when(hundred == 3, "Redirect")
        .when(hundred == 4, "Client Error")
        .when(hundred == 5, "Server Error")
        .otherwise("Unknown")
    )


def syslog_priority(priority: Column) -> Column:
    """Struct(facility, severity) of a syslog priority number."""
    number = priority.try_cast("bigint")
    return F.struct(
        F.floor(number / 8).cast("bigint").alias("facility"),
        F.pmod(number, F.lit(8)).cast("bigint").alias("severity"),
    )
