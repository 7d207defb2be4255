"""Lists of blocks dealt into messages of a bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def units(text: str) -> int:
    """Length in UTF-16, as chat services count."""
    return len(text) + sum(c > "￿" for c in text)


def _head(text: str, room: int) -> int:
    """How many characters fit into ``room`` units; one at least, so that something always goes out."""
    if len(text) * 2 <= room:
        return len(text)
    at, used = 0, 0
    for c in text:
        used += 2 if c > "￿" else 1
        if used > room:
            break
        at += 1
    return max(1, at)


def split_block(block: str, room: int, least: int = 200) -> tuple[list[str], str]:
    """Full pieces of a block that is longer than a message, and what is left; cut at the last line end after ``least`` characters, else anywhere."""
    pieces = []
    while units(block) > room:
        upto = _head(block, room)
        cut = block.rfind("\n", 0, upto)
        cut = cut if cut > least else upto
        pieces.append(block[:cut])
        block = block[cut:].lstrip("\n")
    return pieces, block


def split_messages(blocks: DataFrame, *, list_col: str = "list_id", place_col: str = "place", text_col: str = "text", limit: int = 4096, header: str = "", footer: str = "", least: int = 200) -> DataFrame:
    """(list_id, message, text): each list's blocks in order, as many to a message as fit into ``limit`` UTF-16 units.

    Blocks are parted by an empty line and stay whole, but for a block that is
    longer than a message by itself, which is cut. Every message has ``header``
    and ``footer``. Null and empty blocks are left out; a null list id is a list
    like any other; blocks of a list must differ in their place. A list of no
    blocks gives no message.

    A list's blocks come sorted through one task, which holds a message and a
    block at a time, however long the list is.
    """
    front, back = f"{header}\n\n" if header else "", f"\n\n{footer}" if footer else ""
    room = limit - units(front) - units(back)
    if room < 2:
        raise ValueError("header and footer leave no room")

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current, size, number, started = None, "", 0, 0, False
        for part in parts:
            out: list[tuple] = []

            def send(text: str) -> None:
                nonlocal number
                number += 1
                out.append((key, number, front + text + back))

            for own, text in zip(part["key"], part["text"], strict=True):
                if not started or own != key:
                    if current:
                        send(current)
                    key, current, size, number, started = own, "", 0, 0, True
                n = units(text)
                if current and size + 2 + n <= room:
                    current, size = f"{current}\n\n{text}", size + 2 + n
                    continue
                if current:
                    send(current)
                pieces, current = split_block(text, room, least)
                size = units(current)
                for piece in pieces:
                    send(piece)
            yield pd.DataFrame(out, columns=["key", "message", "text"])
        if current:
            yield pd.DataFrame([(key, number + 1, front + current + back)], columns=["key", "message", "text"])

    kind = blocks.schema[list_col].dataType.simpleString()
    rows = blocks.select(F.to_json(F.struct(F.col(list_col).alias("id"))).alias("key"), F.col(place_col).alias("place"), F.col(text_col).alias("text")).filter("text <> ''")
    dealt = rows.repartition("key").sortWithinPartitions("key", "place").select("key", "text").mapInPandas(deal, "key string, message int, text string")
    return dealt.select(F.from_json("key", f"id {kind}")["id"].alias("list_id"), "message", "text")
