"""Corpus ETL: chunks, boilerplate, page text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.batches import small_batches
from .lineage import cut


def overlapping_chunks(rows: DataFrame, id_: str, text: str, most: int = 480, overlap: int = 32) -> DataFrame:
    """(id, chunk, n_words, content): windows of so many words, each but the first beginning `overlap` words before the last one's end."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    step = most - overlap
    out = rows.select(id_, words.alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - overlap) / step), F.lit(1)).cast("int") - 1
    out = out.select(id_, "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice("_w", F.col("chunk") * step + 1, F.lit(most))
    return out.select(id_, "chunk", F.size(part).alias("n_words"), F.array_join(part, " ").alias("content"))


def boilerplate_lines(chunks: DataFrame, doc: str, chunk: str, text: str, share: float = 0.5, least: int = 2, from_chunks: int = 3) -> DataFrame:
    """(doc, line, n): lines in at least max(least, share of the chunks) chunks of a document that has at least so many chunks."""
    lines = chunks.select(doc, chunk, F.explode(F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""))).alias("line"))
    counts = lines.groupBy(doc, "line").agg(F.count("*").alias("n"))
    sizes = chunks.groupBy(doc).agg(F.countDistinct(chunk).alias("_n")).where(F.col("_n") >= from_chunks)
    return counts.join(sizes, doc).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("_n") * share))).select(doc, "line", "n")


def without_lines(chunks: DataFrame, lines: DataFrame, doc: str, chunk: str, text: str) -> DataFrame:
    """chunks with content: the text without the given lines of its document. Lines meet by a join; a text's own are put together again."""
    each = chunks.select(doc, chunk, F.posexplode_outer(F.split(text, "\n", -1)).alias("_p", "_x")).withColumn("line", F.trim("_x"))
    gone = lines.select(F.col(doc).alias("_d"), "line", F.lit(True).alias("_g")).distinct()
    marked = each.join(gone, each[doc].eqNullSafe(gone["_d"]) & (each["line"] == gone["line"]), "left").select(doc, chunk, "_p", F.when(F.col("_g").isNull(), F.col("_x")).alias("_k"))
    listed = marked.groupBy(doc, chunk).agg(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_p", "_k")))).alias("_l"))
    return listed.select(doc, chunk, F.array_join("_l._k", "\n").alias("content"))


def paragraphs(rows: DataFrame, id_: str, text: str) -> DataFrame:
    return rows.select(id_, F.posexplode(F.filter(F.split(text, r"\n+"), lambda x: F.trim(x) != "")).alias("position", "paragraph"))


def page_numbers(text: Column) -> Column:
    """The numbers of <!-- PAGE n --> markers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<!--\s*PAGE\s+(\d+)\s*-->"), 1), lambda x: x.cast("int"))


def title_of(path: Column) -> Column:
    """The file name of a path, without its ending, joining signs as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]{1,5}$", ""), r"[_-]+", " "))


def _plain(x: str | None) -> str | None:
    gone = dict.fromkeys([*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF, 0x00AD])
    if x is None or x.isascii():
        return x
    x = unicodedata.normalize("NFC", x.translate(gone))
    return "".join(unicodedata.normalize("NFKC", c) if 0x1D400 <= ord(c) <= 0x1D7FF else c for c in x)


def normalized_unicode(text: Column) -> Column:
    """NFC, without zero-width and bidi signs and variation selectors; mathematical letters as plain ones."""
    small_batches()

    @F.pandas_udf("string")
    def plain(x: pd.Series) -> pd.Series:
        return x.map(_plain)

    return plain(text)


def words_in(text: str) -> int:
    return len(text.split())


#: Where a span that is too long is cut, the coarsest first: paragraphs, lines (rows of tables, items of lists), sentences, words.
_CUTS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+"))
_HEADING = re.compile(r"^(#{1,6}) +(.*)$")
_PAGE = re.compile(r"<!--\s*PAGE\s+(\d+)\s*-->")
_RULE = re.compile(r"^\s*\|[\s:|\-]+\|?\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
#: A last piece of under this share of the most is evened out with the one before.
_TAIL = 0.35

Chunk = tuple[str, str, int, int, int]


def _sections(text: str) -> list[tuple[tuple[str, ...], int, int]]:
    """(headings above, start, end) of each section of Markdown; a page mark before a heading belongs to it."""
    stack: list[tuple[int, str]] = []
    out: list[list] = [[(), 0, 0]]
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if m := _HEADING.match(line):
            stack = [*(x for x in stack if x[0] < len(m[1])), (len(m[1]), m[2].strip())]
            own = text[out[-1][1] : at]
            tail = re.search(r"(?:\s*<!--\s*PAGE\s+\d+\s*-->)+\s*$", own)
            start = out[-1][1] + tail.start() if tail else at
            out[-1][2] = start
            out.append([tuple(t for _, t in stack), start, end])
        out[-1][2] = min(end + 1, len(text))
        at = end + 1
    return [(path, a, b) for path, a, b in out if text[a:b].strip()]


def _parts(text: str, a: int, b: int, cut: re.Pattern) -> list[tuple[int, int]]:
    """Spans between the cuts, without blank ones. Lines that go on with an item of a list stay with it."""
    out, at = [], a
    for m in [*cut.finditer(text, a, b), None]:
        end = m.start() if m else b
        if text[at:end].strip():
            if cut is _CUTS[1] and out and _ITEM.match(text[out[-1][0] : out[-1][1]]) and text[at : at + 1].isspace() and not _ITEM.match(text[at:end]):
                out[-1] = (out[-1][0], end)
            else:
                out.append((at, end))
        at = m.end() if m else b
    return out


def _packed(text: str, units: list[tuple[int, int]], most: int, count: Callable[[str], int], level: int) -> list[tuple[int, int]]:
    """Neighbouring units joined as long as they hold at most so many tokens; longer units are cut at the next level."""
    groups: list[list[tuple[int, int]]] = []
    for a, b in units:
        if count(text[a:b]) > most:
            groups += [[x] for x in _split(text, a, b, most, count, level + 1)]
            groups.append([])
        elif groups and groups[-1] and count(text[groups[-1][0][0] : b]) <= most:
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
    groups = [g for g in groups if g]
    size = lambda g: count(text[g[0][0] : g[-1][1]])
    while len(groups) > 1 and len(groups[-2]) > 1 and size(groups[-1]) < _TAIL * most:
        before, tail = groups[-2][:-1], [groups[-2][-1], *groups[-1]]
        if size(tail) > most or abs(size(before) - size(tail)) > abs(size(groups[-2]) - size(groups[-1])):
            break
        groups[-2:] = [before, tail]
    return [(g[0][0], g[-1][1]) for g in groups]


def _split(text: str, a: int, b: int, most: int, count: Callable[[str], int], level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most so many tokens, by the coarsest cut that there is."""
    if count(text[a:b]) <= most or b - a <= 1:
        return [(a, b)]
    for k in range(level, len(_CUTS)):
        parts = _parts(text, a, b, _CUTS[k])
        if len(parts) > 1:
            return _packed(text, parts, most, count, k)
    half = (a + b) // 2
    return _split(text, a, half, most, count, len(_CUTS)) + _split(text, half, b, most, count, len(_CUTS))


def markdown_chunks(text: str, threshold: int = 500, tiny: int = 100, count: Callable[[str], int] = words_in) -> list[Chunk]:
    """(heading path, content, tokens, start, end) of Markdown: contents are the text between start and end, trimmed.

    Neighbouring sections under the same headings are joined below the threshold, and tiny ones are taken in by a larger section that they are
    under. Sections of over twice the threshold are cut, and rows of a table that is cut stay behind its header."""
    joined: list[list] = []
    for path, a, b in _sections(text):
        n = count(text[a:b])
        before = joined[-1] if joined else None
        under = before and len(path) > len(before[0]) and path[: len(before[0])] == before[0]
        if before and before[3] + n < threshold and (before[0] == path or (under and n < tiny <= before[3])):
            before[2], before[3] = b, before[3] + n
        else:
            joined.append([path, a, b, n])
    out: list[Chunk] = []
    for path, a, b, _ in joined:
        for x, y in _split(text, a, b, 2 * threshold, count):
            content = text[x:y].strip()
            table = re.search(r"(?:^|\n)([^\n]*\|[^\n]*\n[^\n]*)\n?$", text[a:x]) and _header_before(text, a, x, content)
            content = f"{table}\n{content}" if table else content
            if content:
                out.append((" > ".join(path), content, count(content), x, y))
    return out


def _header_before(text: str, a: int, x: int, content: str) -> str:
    """The two header lines of the table that a piece goes on with; empty if it is no rows of a table, or begins with the header itself."""
    if not content.startswith("|"):
        return ""
    rows: list[str] = []
    for line in reversed(text[a:x].rstrip("\n").split("\n")):
        if not line.lstrip().startswith("|"):
            break
        rows.append(line)
    rows.reverse()
    return "\n".join(rows[:2]) if len(rows) > 1 and _RULE.match(rows[1]) else ""


def semantic_chunks(rows: DataFrame, id_: str, text: str, threshold: int = 500, count: Callable[[str], int] = words_in) -> DataFrame:
    """(id, position, heading, content, tokens, char_start, char_end, page_start, page_end) by markdown_chunks, Arrow batches of texts at a time.

    count: the tokenizer's number of tokens of a text. Pages are those of the markers that a chunk holds."""
    names = [id_, "position", "heading", "content", "tokens", "char_start", "char_end", "page_start", "page_end"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                for k, (heading, content, n, a, b) in enumerate(markdown_chunks(t, threshold, count=count) if t else ()):
                    pages = [int(p) for p in _PAGE.findall(content)] or [None]
                    found.append((i, k, heading, content, n, a, b, pages[0], pages[-1]))
            out = pd.DataFrame(found, columns=names)
            yield out.astype({"page_start": "Int32", "page_end": "Int32"})

    kind = dict(rows.dtypes)[id_]
    return rows.select(id_, text).mapInPandas(cut, f"{id_} {kind}, position int, heading string, content string, tokens int, char_start int, char_end int, page_start int, page_end int")


def passages(rows: DataFrame, id_: str, text: str, most: int, least: int) -> DataFrame:
    """(id, position, passage): paragraphs joined in order as long as they have at most so many characters (with two a paragraph for the blank line); passages of under `least` go."""

    @F.pandas_udf("array<string>")
    def join(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            groups: list[list[str]] = []
            size = 0
            for p in filter(None, map(str.strip, re.split(r"\n{2,}", t or ""))):
                if groups and size + len(p) + 2 <= most:
                    groups[-1].append(p)
                    size += len(p) + 2
                else:
                    groups.append([p])
                    size = len(p) + 2
            out.append([x for x in map("\n\n".join, groups) if len(x) >= least])
        return pd.Series(out)

    return rows.select(id_, F.posexplode(join(F.col(text))).alias("position", "passage"))


def with_chunker(rows: DataFrame, id_: str, text: str, chunker: Callable[[str], Sequence[dict]]) -> DataFrame:
    """(id, position, content, tokens) by a chunker of one's own, which gives a list of dicts with content and tokens for a text; anything else is refused."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                made = chunker(t or "")
                if not isinstance(made, (list, tuple)) or not all(isinstance(x, dict) and "content" in x for x in made):
                    raise TypeError("a chunker gives a list of dicts with content")
                found += [(i, k, x["content"], x.get("tokens", words_in(x["content"]))) for k, x in enumerate(made)]
            yield pd.DataFrame(found, columns=[id_, "position", "content", "tokens"])

    return rows.select(id_, text).mapInPandas(cut, f"{id_} {dict(rows.dtypes)[id_]}, position int, content string, tokens int")


def token_counts(text: Column, count: Callable[[str], int]) -> Column:
    """The number of tokens of each text by a tokenizer of one's own, Arrow batches at a time."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t) if t is not None else 0).astype("int32")

    return counted(text)


def unique_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """files with unique_name: the second file of a name gets _1 before its ending, the third _2, and so on.

    Files are dealt by range of name and order and counted in each part; the number of a file is its place in the part and the files of its name in the parts before. So a name that very many
    files have is dealt to several tasks. What is collected is a row for each name that goes over the end of a part, two a part at most."""
    dealt = cut(files.repartitionByRange(name, order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy(name, "_p").agg(F.count("*").alias("_m"))
    several = sizes.join(sizes.groupBy(name).agg(F.count("*").alias("_c")).where("_c > 1"), name)
    ahead = several.select(name, "_p", (F.sum("_m").over(Window.partitionBy(name).orderBy("_p")) - F.col("_m")).alias("_a"))
    numbered = dealt.join(F.broadcast(ahead), [name, "_p"], "left")
    n = F.row_number().over(Window.partitionBy(name, "_p").orderBy(order)) - 1 + F.coalesce("_a", F.lit(0))
    ending = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    new = F.when(n == 0, F.col(name)).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), n.cast("string"), ending))
    return numbered.withColumn("unique_name", new).drop("_p", "_a")


def citation_support(sentences: DataFrame, chunks: DataFrame, sentence: str, chunk: str, text: str, words: str, least: float, most: int = 3) -> DataFrame:
    """(sentence, chunk, score, rank): the chunks that hold the largest share of a sentence's words of four letters or more.

    A chunk that holds a share `least` of n words holds one of any n - ceil(least * n) + 1 of them: a sentence meets chunks by its rarest words alone, so a word that nearly all
    chunks hold pairs nothing; the pairs are then verified by all words. Word counts are over all chunks."""
    token = lambda c: F.array_distinct(F.filter(T.tokens(F.col(c), T.WORD), lambda w: F.length(w) >= 4))
    s = sentences.select(sentence, token(text).alias("_t")).where(F.size("_t") > 0)
    c = chunks.select(chunk, token(words).alias("_all"))
    each = c.select(chunk, F.explode("_all").alias("_w"))
    counts = each.groupBy("_w").agg(F.count("*").alias("_c"))
    asked = s.select(sentence, F.size("_t").alias("_n"), F.explode("_t").alias("_w")).join(counts, "_w", "left")
    needed = F.greatest(F.col("_n") - F.ceil(F.col("_n") * least - 1e-6) + 1, F.lit(1))
    rare = Window.partitionBy(sentence).orderBy(F.coalesce("_c", F.lit(0)), "_w")
    rarest = asked.withColumn("_r", F.row_number().over(rare)).where((F.col("_r") <= needed) & F.col("_c").isNotNull()).select(sentence, "_w")
    pairs = rarest.join(each, "_w").select(sentence, chunk).distinct()
    hits = pairs.join(s, sentence).join(c, chunk).select(sentence, chunk, F.round(F.size(F.array_intersect("_t", "_all")) / F.size("_t"), 6).alias("score"))
    order = Window.partitionBy(sentence).orderBy(F.desc("score"), chunk)
    return hits.where((F.col("score") >= least) & (F.col("score") > 0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
