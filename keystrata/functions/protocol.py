"""The line protocol, as column expressions.

A request is one chunk of text. A trailing run of CR and LF goes; then blanks
(no other white space) are stripped, the command ends at the first blank, and
the stripped rest is its argument. ``save_key`` and ``update`` split their
argument once more, into key and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMANDS = ("save", "save_key", "lookup", "update", "delete", "connect", "create_db", "delete_db")
KEYED = ("save_key", "update")


def chomp(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[\r\n]+\z", "")


def head(text: Column) -> Column:
    """Up to the first blank of the stripped text."""
    return F.regexp_extract(F.trim(text), r"(?s)\A([^ ]*)", 1)


def tail(text: Column) -> Column:
    """Behind the first blank of the stripped text, stripped."""
    return F.trim(F.regexp_extract(F.trim(text), r"(?s)\A[^ ]*(.*)\z", 1))


def parse(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds command, args, key, doc and valid. ``doc`` is never null for commands
    that write; ``key`` is null where a command has none. A null line is an empty
    one. Columns of ``lines`` with one of these names are replaced."""
    line = chomp(F.coalesce(F.col(raw), F.lit("")))
    out = lines.withColumns({"command": head(line), "args": tail(line)})
    command, args = F.col("command"), F.col("args")
    return out.withColumns(
        {
            "key": F.when(command.isin(*KEYED), head(args)).when(command.isin("lookup", "delete"), args),
            "doc": F.when(command.isin(*KEYED), tail(args)).when(command == "save", args),
            "valid": command.isin(*COMMANDS),
        }
    )
