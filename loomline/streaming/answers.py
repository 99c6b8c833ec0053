"""Answers that come as a stream of tokens, without the parts in which a model reasons."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


def _held(text: str, mark: str) -> int:
    """How many of the last characters may begin a mark."""
    return next((n for n in range(min(len(text), len(mark) - 1), 0, -1) if mark.startswith(text[-n:])), 0)


def feed(state: tuple[str, bool, bool, str], text: str) -> tuple[tuple[str, bool, bool, str], str]:
    """What can be shown once more text has come, and the new state.

    A state is text held back as it may begin a mark, whether it stands inside a block, whether anything was shown, and spaces that are shown only if something follows."""
    rest, inside, shown, spaces = state
    rest += text
    out = []
    while True:
        mark = CLOSE if inside else OPEN
        at = rest.find(mark)
        if at < 0:
            keep = _held(rest, mark)
            if not inside:
                out.append(rest[: len(rest) - keep])
            rest = rest[len(rest) - keep :]
            break
        if not inside:
            out.append(rest[:at])
        rest, inside = rest[at + len(mark) :], not inside
    ready = spaces + "".join(out)
    body = ready.rstrip(" ")
    spaces = ready[len(body) :]
    if not shown:
        body = body.lstrip(" ")
        spaces = spaces if body else ""
    return (rest, inside, shown or bool(body), spaces), body


def finish(state: tuple[str, bool, bool, str]) -> str:
    """What is shown at an answer's end: text that began no mark after all; an open block never ends and shows nothing."""
    rest, inside, shown, spaces = state
    if inside:
        return ""
    body = (spaces + rest).rstrip(" ")
    return body if shown else body.lstrip(" ")


START = ("", False, False, "")


def visible(tokens: DataFrame, timeout: str | None = None) -> DataFrame:
    """(answer, position, text): the visible pieces of a stream (answer, position, token, done), in which blocks of reasoning are left out though their marks may be cut across tokens and batches.

    Put together, the pieces of an answer are its whole text without closed blocks and without a block that is left open, trimmed. The tokens of an answer come in order of position from
    batch to batch, and in any order within one. A row that is done ends its answer; with a timeout (processing time, such as `10 minutes`) an answer that hears nothing for so long ends with what it has, and
    what comes later begins anew. Timeouts ask for batches without data, so a query that is to end by itself (availableNow) goes without. A null token is empty. State is a few characters an answer."""
    wait = None if timeout is None else int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, rest = state.get[4], finish(tuple(state.get[:4]))
            state.remove()
            if rest:
                yield pd.DataFrame({"answer": [key[0]], "position": [last], "text": [rest]})
            return
        rows = pd.concat(list(parts)).sort_values("position", kind="stable")
        now, last = (tuple(state.get[:4]), state.get[4]) if state.exists else (START, -1)
        out, ended = [], False
        for position, token, done in zip(rows["position"], rows["token"], rows["done"], strict=True):
            now, text = feed(now, token if isinstance(token, str) else "")
            last = int(position)
            if done is True or done == 1:
                text, now, ended = text + finish(now), START, True
            else:
                ended = False
            if text:
                out.append((key[0], last, text))
        if ended:
            state.remove()
        else:
            state.update((*now, last))
            if wait is not None:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["answer", "position", "text"])

    kind = dict(tokens.dtypes)["answer"]
    schema, kept = f"answer {kind}, position long, text string", "rest string, inside boolean, shown boolean, spaces string, last long"
    return tokens.groupBy("answer").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout)
