"""Edit-aware token counts.

Each text keeps a segment tree over its pre-tokens (the units that a byte-pair encoder never merges across): the leaves
are blocks of whole pre-tokens with their characters and tokens, inner nodes the sums of two children. An edit finds its
blocks by descending the tree, re-encodes the touched blocks with two blocks of context at the left, and goes on to the
right until a block boundary of the old text is a pre-token boundary of the new one; then the sums above change.

Null and empty texts have one empty leaf. Edits outside a text are clipped to it; a null edit changes nothing. Edits of
one text apply in order. Very long texts are encoded whole, once. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

#: Pre-tokens per leaf.
LEAF = 32


@dataclass
class Tokenizer:
    """Counts tokens of pre-tokens; counts of recent pre-tokens are kept, up to `most` of them."""

    ranks: dict[bytes, int]
    pattern: str
    most: int = 400_000

    def __post_init__(self) -> None:
        import regex
        import tiktoken

        self.find = regex.compile(self.pattern).findall
        self.encode = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, int] = {}

    def count(self, pre: str) -> int:
        n = self.kept.get(pre)
        if n is None:
            n = len(self.encode(pre))
            if len(self.kept) < self.most:
                self.kept[pre] = n
        return n

    def leaves(self, text: str) -> list[tuple[int, int]]:
        """(characters, tokens) of each block of LEAF pre-tokens."""
        pre = self.find(text)
        if not pre:
            return [(0, 0)]
        n, kept, count = [len(p) for p in pre], self.kept, self.count
        t = [kept[p] if p in kept else count(p) for p in pre]
        return [(sum(n[i : i + LEAF]), sum(t[i : i + LEAF])) for i in range(0, len(pre), LEAF)]


def read_tokenizer(file: str, pattern: str) -> Tokenizer:
    with open(file, "rb") as f:
        return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


class Tree:
    """Sums over leaves in levels: level 0 has the leaves, each higher one the sums of two neighbours below."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            x = self.levels[-1]
            self.levels.append([(x[i][0] + x[i + 1][0], x[i][1] + x[i + 1][1]) if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)])

    @classmethod
    def of(cls, levels: list[list[tuple[int, int]]]) -> Tree:
        """A kept tree."""
        tree = cls.__new__(cls)
        tree.levels = levels
        return tree

    @property
    def total(self) -> tuple[int, int]:
        return self.levels[-1][0]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the character at which it starts."""
        k = start = 0
        for x in self.levels[-2::-1]:
            k *= 2
            if k + 1 < len(x) and char >= start + x[k][0]:
                start += x[k][0]
                k += 1
        return k, start

    def replace(self, a: int, b: int, new: list[tuple[int, int]]) -> None:
        """Leaves a..b-1 give way to new. Sums change only above them; if their number changes, also to their right."""
        same = len(new) == b - a
        self.levels[0][a:b] = new
        low, high = a, a + len(new) if same else len(self.levels[0])
        for i in range(1, 64):
            below = self.levels[i - 1]
            if len(below) <= 1:
                del self.levels[i:]
                return
            if i == len(self.levels):
                self.levels.append([])
            low, high = low // 2, (high + 1) // 2
            sums = [(below[j][0] + below[j + 1][0], below[j][1] + below[j + 1][1]) if j + 1 < len(below) else below[j] for j in range(2 * low, min(2 * high, len(below)), 2)]
            self.levels[i][low : low + len(sums) if same else None] = sums


def apply_edit(text: str, tree: Tree, at: int, remove: int, insert: str, tok: Tokenizer) -> tuple[str, int]:
    """Edit text[at:at+remove] to insert and update the tree; returns the new text and the characters re-encoded.

    The context at the left is two leaves, so two pre-tokens at least: a run of blanks, the only thing that the pattern
    looks ahead over, is two at most. At the right, leaves are taken in until one begins where a pre-token of the new
    text begins too: from there on both texts agree, and so do their pre-tokens."""
    at = min(max(at, 0), len(text))
    remove = min(max(remove, 0), len(text) - at)
    new = text[:at] + insert + text[at + remove :]
    leaves = tree.levels[0]
    a, start = tree.leaf_at(at)
    for _ in range(min(2, a)):
        a -= 1
        start -= leaves[a][0]
    b, end = tree.leaf_at(at + remove)
    end += leaves[b][0]
    b += 1
    grown = len(insert) - remove
    while True:
        part = new[start : end + grown]
        far = end + grown + 64
        while far < len(new) and new[far - 1].isspace():  # a run of blanks is seen whole
            far += 64
        follow = new[end + grown : far]
        pos, starts = 0, set()
        for p in tok.find(part + follow):
            starts.add(pos)
            pos += len(p)
        if b >= len(leaves) or len(part) in starts:
            break
        end += leaves[b][0]
        b += 1
    pre, pos, done = tok.find(part + follow), 0, []
    for p in pre:
        if pos >= len(part):
            break
        done.append(p)
        pos += len(p)
    made = [(sum(map(len, done[i : i + LEAF])), sum(map(tok.count, done[i : i + LEAF]))) for i in range(0, len(done), LEAF)]
    keep_one = a == 0 and b == len(leaves)
    tree.replace(a, b, made or ([(0, 0)] if keep_one else []))
    if not tree.levels[0]:
        tree.levels = [[(0, 0)]]
    return new, len(part)


TREE = "array<array<struct<chars:long,tokens:long>>>"
NODE = pa.struct([("chars", pa.int64()), ("tokens", pa.int64())])


def _run(file: str, pattern: str, id_col: str):
    """id, text, edits, tree (null: made from the text) -> id, text, tokens_before, tokens_after, n_leaves, reencoded_chars,
    chars_after, tree. Null texts stay null where they have no edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = read_tokenizer(file, pattern)
        for x in text_batches(batches, "text"):
            out = []
            for given, edits, kept in zip(*[x.column(c).to_pylist() for c in (1, 2, 3)]):
                text, edits = given or "", [e for e in edits or [] if e is not None]
                tree = Tree(tok.leaves(text)) if kept is None else Tree.of([[(n["chars"], n["tokens"]) for n in level] for level in kept])
                before, again = tree.total[1], 0
                for e in edits:
                    text, n = apply_edit(text, tree, e["at"] or 0, e["remove"] or 0, e["insert"] or "", tok)
                    again += n
                levels = [[{"chars": c, "tokens": t} for c, t in level] for level in tree.levels]
                out.append((text if edits else given, before, tree.total[1], len(tree.levels[0]), again, tree.total[0], levels))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.list_(NODE))]
            yield pa.record_batch([x.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=[id_col, "text", *COUNTS, "tree"])

    return run


COUNTS = ["tokens_before", "tokens_after", "n_leaves", "reencoded_chars", "chars_after"]


def keep_trees(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """docs(id, text[, edits][, tree]) -> id, text (edited), the counts, tree (levels from the leaves up, with characters and
    tokens). To be stored: with the next edits beside it, the result is the next call's input, which encodes what they touch
    and nothing else. A text without a tree is encoded whole, once; a tree must be of its text."""
    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    none = {"edits": "array<struct<at:int,remove:int,insert:string>>", "tree": TREE}
    cols = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
    longs = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(id_col, "text", *cols).mapInArrow(_run(file, pattern, id_col), f"{id_col} {kind}, text string, {longs}, tree {TREE}")


def count_edits(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """docs(id, text, edits array<struct<at int, remove int, insert string>>) -> id, tokens_before, tokens_after,
    n_leaves, reencoded_chars, chars_after, sums (the tree's levels from the root down to its leaves, tokens)."""
    got = keep_trees(docs.select(id_col, "text", "edits"), file, pattern, id_col)
    return got.select(id_col, *COUNTS, F.transform(F.reverse("tree"), lambda level: F.transform(level, lambda n: n["tokens"])).alias("sums"))
