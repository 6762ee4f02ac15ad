"""Exports of boards, backlogs and notifications; an empty result never replaces an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _write(df: DataFrame, path: str, kind: str, by: str | None = None) -> None:
    if df.isEmpty():
        raise ValueError(f"nothing to write; {path} stays as it is")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def write_board(compact: DataFrame, path: str) -> None:
    """Compact board rows as JSON, a folder for each tier."""
    _write(compact, path, "json", "g")


def write_backlog(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Backlog rows in their order as JSON, or their table lines as text."""
    _write(rows.select("line") if kind == "text" else rows, path, kind)


def write_messages(messages: DataFrame, path: str) -> None:
    """Notification payloads, one message a line."""
    _write(messages, path, "json")
