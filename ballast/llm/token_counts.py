"""Edit-aware token counts.

A document is a segment tree: its leaves hold the pre-tokens (segments between
which no token can reach) with their token counts, its inner nodes the sums of
characters and tokens below.  An edit finds its place by the character sums,
splits and encodes anew only what it touches and a few characters of context,
and updates the sums on the way up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import small_batches, task
from ballast.llm.bpe import Encoder, Vocabulary, _double, encoder_for

#: How many characters before a place can influence how the text splits there, and how many after.
CONTEXT = 4


class Leaf:
    """A run of pre-tokens: their joint text, and the length and token count of each."""

    __slots__ = ("counts", "lengths", "text")

    def __init__(self, text: str, lengths: list[int], counts: list[int]):
        self.text, self.lengths, self.counts = text, lengths, counts


class TokenTree:
    WIDTH = 64

    def __init__(self, encoder: Encoder, text: str):
        self.encoder = encoder
        #: Pre-tokens that edits have encoded so far.
        self.reencoded = 0
        self._build(*self._split(text), text)

    def _split(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the text's pre-tokens; where all spaces stand alone each is what lies between two."""
        encoder = self.encoder
        if encoder.spaced and " " in text and not (text[0].isspace() or text[-1].isspace() or _double.search(text)):
            first, *rest = text.split(" ")
            lengths = [n + 1 for n in map(len, rest)]
            counts = [n // 4 for n in map(len, map(encoder.words.__getitem__, rest))]
            return [len(first), *lengths], [self._count(encoder.split.findall(first)), *counts]
        pieces = encoder.split.findall(text)
        return list(map(len, pieces)), [n // 4 for n in map(len, map(encoder.pieces.__getitem__, pieces))]

    def _count(self, pieces: list[str]) -> int:
        return sum(len(self.encoder.pieces[p]) for p in pieces) // 4

    def _build(self, lengths: list[int], counts: list[int], text: str) -> None:
        self.leaves: list[Leaf] = []
        at = 0
        for k in range(0, max(1, len(lengths)), self.WIDTH):
            own = lengths[k : k + self.WIDTH]
            end = at + sum(own)
            self.leaves.append(Leaf(text[at:end], own, counts[k : k + self.WIDTH]))
            at = end
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = len(leaf.text), sum(leaf.counts)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at a place, and the place where it begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters ``start`` to ``end`` (both are cut to the text) by ``new``."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        first, leaf_begin = self._find(max(0, start - CONTEXT))
        # the pre-token at the context's first character: from its beginning the text is split anew
        index, begin = 0, leaf_begin
        lengths = self.leaves[first].lengths
        while index < len(lengths) - 1 and begin + lengths[index] <= start - CONTEXT:
            begin += lengths[index]
            index += 1
        last, old_end = first, leaf_begin + len(self.leaves[first].text)
        old = self.leaves[first].text[begin - leaf_begin :]
        borders, at = set(), begin  # the ends of old pre-tokens, as places in the old text
        for n in lengths[index:]:
            at += n
            borders.add(at)
        growth = len(new) - (end - start)
        while True:
            complete = last == len(self.leaves) - 1
            if old_end >= end:
                fresh = old[: start - begin] + new + old[end - begin :]
                pieces, same = [], old_end if complete else None
                for match in self.encoder.split.finditer(fresh):
                    place = match.start() + begin - growth
                    if place >= end and place in borders and match.start() >= start - begin + len(new):
                        if complete or match.start() <= len(fresh) - CONTEXT:
                            same = place
                        break
                    pieces.append(match[0])
                if same is not None:
                    break
            last += 1
            leaf = self.leaves[last]
            old += leaf.text
            for n in leaf.lengths:
                old_end += n
                borders.add(old_end)
        self._splice(first, index, last, begin, same, pieces)

    def _splice(self, first: int, index: int, last: int, begin: int, same: int, pieces: list[str]) -> None:
        """Puts pieces in the place of the old pre-tokens between two places; all goes to the first leaf, the others it took from are emptied."""
        self.reencoded += len(pieces)
        leaf = self.leaves[first]
        head = sum(leaf.lengths[:index])
        old_lengths = leaf.lengths[index:] + [n for other in self.leaves[first + 1 : last + 1] for n in other.lengths]
        old_counts = leaf.counts[index:] + [n for other in self.leaves[first + 1 : last + 1] for n in other.counts]
        old_text = leaf.text[head:] + "".join(other.text for other in self.leaves[first + 1 : last + 1])
        gone, k = same - begin, 0
        at = 0
        while at < gone:
            at += old_lengths[k]
            k += 1
        leaf.text = leaf.text[:head] + "".join(pieces) + old_text[gone:]
        leaf.lengths = leaf.lengths[:index] + list(map(len, pieces)) + old_lengths[k:]
        leaf.counts = leaf.counts[:index] + [len(self.encoder.pieces[p]) // 4 for p in pieces] + old_counts[k:]
        for other in self.leaves[first + 1 : last + 1]:
            other.text, other.lengths, other.counts = "", [], []
        if len(leaf.lengths) > 8 * self.WIDTH:
            self._build([n for x in self.leaves for n in x.lengths], [n for x in self.leaves for n in x.counts], self.text)
            return
        for k in range(first, last + 1):
            node = self.size + k
            self.chars[node], self.tokens[node] = len(self.leaves[k].text), sum(self.leaves[k].counts)
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2


@task("bpe", keep=True)
def _counted(batches, held, pattern):
    encoder = encoder_for(held, pattern)
    for batch in batches:
        before, after, anew = [], [], []
        for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
            tree = TokenTree(encoder, text or "")
            before.append(tree.n_tokens)
            for e in edits or []:
                if e is not None and e["start"] is not None and e["end"] is not None:
                    tree.edit(e["start"], e["end"], e["new"] or "")
            after.append(tree.n_tokens)
            anew.append(tree.reencoded)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (before, after, anew))], ["doc_id", "n_tokens", "n_tokens_edited", "n_reencoded"])


def edited_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Token counts before and after edits of every row of ``docs(doc_id, text, edits)``.

    ``edits`` is an array of ``(start, end, new)``, applied one after another to
    the text as it then is; places beyond the text are cut to it.  Null texts
    count as empty, null edits as none, a null ``new`` as empty; repeated rows
    give repeated rows; further columns are ignored.  Returns doc_id, n_tokens,
    n_tokens_edited, n_reencoded (pre-tokens that the edits encoded anew).
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "edits").mapInArrow(
        lambda batches: _counted(batches, held, pattern), f"doc_id {id_type}, n_tokens long, n_tokens_edited long, n_reencoded long"
    )


def sample_edits(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Three edits for each document, at places that a hash of its id gives: an insertion, a deletion and a replacement."""
    size = F.coalesce(F.length(text), F.lit(0))

    def place(k: int) -> Column:
        return F.pmod(F.crc32(F.concat_ws(":", F.col(doc_id).cast("string"), F.lit(str(k))).cast("binary")), size + 1)

    def one(k: int, removed: int, new: str) -> Column:
        return F.struct(place(k).alias("start"), (place(k) + removed).alias("end"), F.lit(new).alias("new"))

    return F.array(one(0, 0, " revised"), one(1, 12, ""), one(2, 6, "x 1"))
