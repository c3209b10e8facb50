"""Main text of web pages: one pass over tags, then a choice of blocks by their density of text and links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they are read.
#: What they hold is no text of the page.
HIDDEN = ("head", "script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select")
#: What they hold is read as it is up to the end tag, tags included.
RAW = ("script", "style", "textarea", "title")
#: They go around the main text, and are left out with all they hold.
AROUND = ("nav", "header", "footer", "aside", "form", "button", "menu", "dialog")
#: Other elements that stand on lines of their own.
BLOCKS = (
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section"
    " summary table tbody td tfoot th thead tr ul"
).split()

_SKIPPED = {*HIDDEN, *AROUND} - {"textarea"}
_OWN_LINE = {*BLOCKS, *AROUND, *HIDDEN, "title"}
#: No `<` within a tag, so that a page of tags that are never closed is read in one pass, too.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/><\x00]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<!--.*?(?:-->|\Z)|<[!?/][^<>]*(?:>|\Z)", re.DOTALL
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
_BLANKS = re.compile(r"\s+")


def blocks(page: str) -> Iterator[tuple[str, int]]:
    """Blocks of text of a page in order, each with the number of its characters inside links.

    A state machine over tags: a block ends at any tag of an element that stands on lines of its
    own. Comments, and elements that hide what they hold or stand around the main text, are left
    out; an end tag closes the nearest open element of its name, and is ignored if there is none. What
    is never closed ends with the page. A `<` that begins no tag is text.
    """
    held: list[str] = []
    linked = depth = 0
    skipped: list[str] = []
    at = 0

    def closed() -> Iterator[tuple[str, int]]:
        nonlocal linked
        text = _BLANKS.sub(" ", "".join(held)).strip()
        if text:
            yield text, min(linked, len(text))
        held.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not skipped:
            text = html.unescape(raw)
            held.append(text)
            if depth:
                linked += len(_BLANKS.sub(" ", text))

    while tag := _TAG.search(page, at):
        take(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name, ends = tag[2].lower(), bool(tag[1])
        if name in _OWN_LINE:
            yield from closed()
        if name == "a":
            depth = 0 if ends else 1
        elif name in _SKIPPED and ends:
            if name in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(name) :]
        elif name in _SKIPPED and not tag[3].endswith("/"):
            skipped.append(name)
        if name in _RAW_END and not ends:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            if name in skipped:
                skipped.remove(name)
    take(page[at:])
    yield from closed()


def main_text(page: str | None, least_words: int = 8, most_linked: float = 0.33) -> str:
    """Blocks of a page that are dense in text, one a line; empty for a null page.

    A block is kept if it has ``least_words`` words or more and at most ``most_linked`` of its
    characters in links, or if it is half as long, as free of links, and next to such a block.
    """
    found = [(text, len(text.split()), linked / len(text)) for text, linked in blocks(page or "")]
    good = [n >= least_words and share <= most_linked for _, n, share in found]
    beside = [
        2 * n >= least_words and share <= most_linked and any(good[max(0, i - 1) : i + 2]) for i, (_, n, share) in enumerate(found)
    ]
    return "\n".join(text for (text, _, _), a, b in zip(found, good, beside, strict=True) if a or b)


def _read(batches: Iterator[pa.RecordBatch], least_words: int, most_linked: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # a few pages at a time: a page may be long
        for first in range(0, len(batch), 64):
            part = batch.slice(first, 64)
            texts = [main_text(page, least_words, most_linked) for page in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["id", "main_text"])


def main_texts(pages: DataFrame, page_id: str, page: str, least_words: int = 8, most_linked: float = 0.33) -> DataFrame:
    """(``page_id``, main_text) of every whole page, one row each; see :func:`main_text`.

    One pass without a shuffle. Null and empty pages have an empty text; ids may be null or repeated;
    columns of other names play no part.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("id"), F.col(page).alias("page"))
    read = rows.mapInArrow(partial(_read, least_words=least_words, most_linked=most_linked), f"id {kind}, main_text string")
    return read.withColumnRenamed("id", page_id)
