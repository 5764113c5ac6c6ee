"""Chunking of documents into sentence-aligned pieces with overlap."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Characters that end sentences, and that open and close what a sentence may not be split in.
TERMINATORS = frozenset("。！？；!?;…")
OPENERS = frozenset("「『“（(【《〈[")
CLOSERS = frozenset("」』”’）)】》〉]\"'")
CHUNK = "doc_id long, strategy string, seq int, start int, end int, token_count int, header string, chunk string"


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens. ``limit`` is the model's, with ``prefix`` and ``specials`` in; a header has at most ``header`` tokens."""

    target: int = 300
    overlap: int = 100
    header: int = 64
    limit: int = 512
    prefix: str = "passage: "
    specials: int = 2

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.target or self.target + self.header + 16 > self.limit:
            raise ValueError("overlap must be under the target, and target, header and 16 within the limit")


class PlainTokens:
    """Words, single CJK characters and marks, for where no vocabulary is at hand."""

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in re.finditer(r"[⺀-鿿豈-﫿]|[^\W⺀-鿿豈-﫿]+|[^\w\s]", text)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.starts(t)) for t in texts]


#: White space and the visible characters after it: between two of these a tokenizer always cuts.
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Other white space, invisible characters and strings that may be special tokens; where a text has any it is counted whole.
_UNSURE = re.compile(r"<\||[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Pieces whose number of tokens a Python worker remembers, and the longest of them.
KNOWN_PIECES, LONGEST_PIECE = 200_000, 100


class VocabularyTokens:
    """The tokens of a vocabulary file of the tokenizers library; special strings in texts are ordinary text.

    What a text's pieces count adds up to what it counts, so a frequent piece meets the tokenizer once a worker.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._known: dict[str, int] = {}

    def starts(self, text: str) -> list[int]:
        """Code points at which tokens begin; the tokens of one character begin at it together."""
        return sorted({a for a, _ in self._tokenizer.encode(text, add_special_tokens=False).offsets})

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [[t] if _UNSURE.search(t) else _PIECE.findall(t) for t in texts]
        known = self._known
        new = list({p for ps in pieces for p in ps}.difference(known))
        fresh = dict(zip(new, self._encoded(new))) if new else {}
        out = [sum([fresh[p] if p in fresh else known[p] for p in ps]) for ps in pieces]
        if len(known) < KNOWN_PIECES:
            known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_PIECE)
        return out


_LOADED: dict[str | None, PlainTokens | VocabularyTokens] = {}


def tokens_of(vocabulary: str | None) -> PlainTokens | VocabularyTokens:
    """The tokenizer of a vocabulary file, loaded once a worker."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = PlainTokens() if vocabulary is None else VocabularyTokens(vocabulary)
    return _LOADED[vocabulary]


#: All characters at which a sentence may begin, end or be held together.
_MARK = re.compile("[\n." + re.escape("".join(sorted(TERMINATORS | OPENERS | CLOSERS - set("\"'")))) + "]")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans that cover ``text``: to a line's end or a terminator outside brackets, with what closes and the blanks after it."""
    spans: list[tuple[int, int]] = []
    start = at = depth = 0
    n = len(text)
    while m := _MARK.search(text, at):
        c, at = m.group(), m.end()
        if c == "\n":
            spans.append((start, at))
            start, depth = at, 0
            continue
        if c in OPENERS:
            depth += 1
            continue
        ends = depth == 0 and (c in TERMINATORS or c == "." and (at == n or text[at].isspace()))
        if depth and c in CLOSERS and c not in "\"'":
            depth -= 1
            ends = depth == 0 and at > 1 and (text[at - 2] in TERMINATORS or text[at - 2] == ".")
        if ends:
            for more in (lambda x: x in TERMINATORS or x == ".", lambda x: x in CLOSERS, lambda x: x.isspace() and x != "\n"):
                while at < n and more(text[at]):
                    at += 1
            spans.append((start, at))
            start = at
    return [*spans, (start, n)] if start < n else spans


def hard_cut(text: str, a: int, b: int, budget: int, tokens) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of pieces that cover a span, cut where tokens begin, each of at most ``budget`` tokens when it is counted by itself.

    A piece by itself may have more tokens than it had within the span; then it is cut once more. One character is never cut.
    """
    done, todo = [], [(a, b, max(1, budget - 1))]
    while todo:
        a, b, step = todo.pop()
        starts = [x for x in tokens.starts(text[a:b])[step::step] if 0 < x < b - a]
        cuts = [a, *[a + x for x in starts], b]
        pieces = list(zip(cuts, cuts[1:]))
        for (x, y), n in zip(pieces, tokens.counts([text[x:y] for x, y in pieces])):
            if n <= budget or y - x == 1 or step == 1:
                done.append((x, y, n))
            else:
                todo.append((x, y, step // 2))
    return sorted(done)


def packed(text: str, config: ChunkConfig, tokens=PlainTokens()) -> list[tuple[int, int]]:
    """Spans of whole sentences up to the target; each begins with up to ``overlap`` tokens of the last, and goes on."""
    units, spans = [], sentences(text)
    for (a, b), n in zip(spans, tokens.counts([text[a:b] for a, b in spans])):
        units += [(a, b, n)] if n <= config.target else hard_cut(text, a, b, config.target, tokens)
    spans, first = [], 0
    while first < len(units):
        last, total = first, units[first][2]
        while last + 1 < len(units) and total + units[last + 1][2] <= config.target:
            last += 1
            total += units[last][2]
        spans.append((units[first][0], units[last][1]))
        if last + 1 == len(units):
            break
        again, carried = last + 1, 0
        while again > first + 1 and carried + units[again - 1][2] <= config.overlap:
            again -= 1
            carried += units[again][2]
        first = again
    return spans


def capped_header(title: str, most: int, tokens) -> str:
    """The longest beginning of a title, up to where a token begins, that has at most ``most`` tokens by itself."""
    if tokens.counts([title])[0] <= most:
        return title
    starts = tokens.starts(title)
    for at in reversed(starts[: most + 1]):
        if tokens.counts([title[:at]])[0] <= most:
            return title[:at]
    return ""


def with_blanks(text: str, spans: list[tuple[int, int]], fits) -> list[tuple[int, int]]:
    """``spans`` where one of nothing but white space goes to the one before it, or at the beginning to the next, if that still fits."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and not (text[a:b].strip() and text[slice(*out[-1])].strip()) and fits((out[-1][0], b)):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def document_chunks(title: str | None, text: str, strategy: str, config: ChunkConfig, tokens) -> list[tuple[int, int, int, str]]:
    """(start, end, token_count, header) of a document's chunks; token_count is of the header, a line's end and the chunk.

    What the model is given - prefix, header, chunk and special tokens - never exceeds the limit. A chunk that begins with the whole title
    has no header. Chunks cover the whole text; a text of nothing but white space has none.
    """
    if not text.strip():
        return []
    head = capped_header(title, config.header, tokens) if title else ""
    within = len(title) if title and text.startswith(title) else None
    header = lambda a, b: "" if within is not None and a == 0 and b >= within else head
    given = lambda a, b: f"{header(a, b)}\n{text[a:b]}" if header(a, b) else text[a:b]
    fits = lambda spans: [n + config.specials <= config.limit for n in tokens.counts([config.prefix + given(a, b) for a, b in spans])]
    spans = [(0, len(text))] if strategy in ("record", "whole") and fits([(0, len(text))])[0] else packed(text, config, tokens)
    out = []
    for (a, b), ok in zip(spans, fits(spans)):
        if ok:
            out.append((a, b))
            continue
        room = config.limit - config.specials - tokens.counts([f"{config.prefix}{head}\n"])[0] - 4
        out += [(x, y) for x, y, _ in hard_cut(text, a, b, max(1, room), tokens)]
    out = with_blanks(text, out, lambda span: fits([span])[0])
    return [(a, b, n, header(a, b)) for (a, b), n in zip(out, tokens.counts([given(a, b) for a, b in out]))]


#: Code points of chunks that a worker holds before it hands them on.
HELD = 1 << 21


def _chunks(config: ChunkConfig, max_bytes: int | None, vocabulary: str | None):
    names = [c.split()[0] for c in CHUNK.split(", ")] + ["truncated"] * (max_bytes is not None)

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()] + [pa.bool_()] * (max_bytes is not None)
        tokens = tokens_of(vocabulary)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows, held = [], 0
        for b in batches:
            # one text at a time becomes a string of Python's, and chunks, which overlap, go on before there are many
            for doc, title, text, strategy in zip(*[b.column(c) for c in ("doc_id", "title", "text", "strategy")]):
                doc, title, text, strategy, cut = doc.as_py(), title.as_py(), text.as_py() or "", strategy.as_py(), ()
                if max_bytes is not None:
                    source = text.encode()
                    text, cut = source[:max_bytes].decode(errors="ignore"), (len(source) > max_bytes,)
                for seq, (start, end, n, head) in enumerate(document_chunks(title, text, strategy, config, tokens)):
                    rows.append((doc, strategy, seq, start, end, n, head, text[start:end], *cut))
                    held += end - start
                    if held >= HELD:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig(), max_bytes: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """Chunks of (doc_id, title, text, object_type): imports are records, articles stay whole if they fit, else packed.

    ``vocabulary`` is the path of a vocabulary file of the tokenizers library, by which tokens are counted and over-long sentences cut; without
    one a plain rule is. The whole text is chunked. With ``max_bytes`` only that much of it is, and a column ``truncated`` tells of which documents.
    """
    kind = F.when(F.col("object_type") == "imported", "record").when(F.col("object_type") == "article", "whole").otherwise("fixed")
    chunks = _chunks(config, max_bytes, vocabulary)
    return docs.select(F.col("doc_id").cast("long"), "title", "text", kind.alias("strategy")).mapInArrow(chunks, CHUNK + ", truncated boolean" * (max_bytes is not None))


def coverage(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_covered, largest): code points that chunks cover, overlaps once, and the largest token count.

    Chunks come in the order of their starts, so what a chunk adds is what lies beyond the furthest end so far.
    """
    before = Window.partitionBy("doc_id", "strategy").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    added = chunks.select("doc_id", "token_count", F.greatest(F.lit(0), F.col("end") - reached).alias("new"))
    return added.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("new").alias("n_covered"), F.max("token_count").alias("largest"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.max("token_count").alias("max_tokens"))


def broken_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose number is not the next of its document, or that end before they start."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "strategy").orderBy("seq")) - 1
    return chunks.withColumn("nth", nth).where((F.col("nth") != F.col("seq")) | (F.col("end") < F.col("start"))).drop("nth")


def changed_documents(new: DataFrame, old: DataFrame) -> DataFrame:
    """Documents whose chunks differ from the stored ones; only those are rewritten."""
    key = ["doc_id", "strategy", "seq", "start", "end", "chunk"]
    differ = new.select(key).exceptAll(old.select(key)).unionByName(old.select(key).exceptAll(new.select(key)))
    return differ.select("doc_id").distinct()
