"""Byte-level BPE in tasks, with the ids of the tokenizer file that a path names.

``Codec`` gives the ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
A text longer than ``LEAF_CHARS`` can be encoded as a tree: halves down to leaves, then joins.
A join re-encodes a window around the cut and widens it until its first and last pieces are
the ones that the two sides already have there. Inside one unsplit piece the same is done with
tokens; a sequence of tokens is the encoding of its bytes when each neighbouring pair is.
"""

import functools
import json
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import regex
import tiktoken

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LEAF_CHARS = 16_000
#: No pattern that splits text looks farther ahead than this many characters after a match.
LOOK_AHEAD = 3


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Node:
    """An encoded stretch of text: its pieces' first characters and first tokens, and its ids."""

    text: str
    starts: np.ndarray
    first: np.ndarray
    ids: np.ndarray


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.encoding = tiktoken.Encoding(
            "corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for null."""
        return self.encoding.encode_to_numpy(text or "", allowed_special="all")

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens, and these; the flag marks them."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def _piece(self, data: bytes) -> list[int]:
        return self.encoding._encode_single_piece(data)

    def leaf(self, text: str) -> Node:
        pieces = [m.span() for m in self.pattern.finditer(text)]
        ids = [self._piece(text[a:b].encode()) for a, b in pieces]
        counts = np.array([len(x) for x in ids], np.int64)
        return Node(
            text,
            np.array([a for a, _ in pieces], np.int64),
            np.cumsum(counts) - counts,
            np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())),
        )

    def join_tokens(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of one piece from the ids of its two parts."""
        width = 4
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            window = self._piece(self.encoding.decode_bytes([*left[len(left) - a :].tolist(), *right[:b].tolist()]))
            agree_left = a == len(left) or window[0] == left[len(left) - a]
            agree_right = b == len(right) or window[-1] == right[b - 1]
            if agree_left and agree_right:
                return np.concatenate([left[: len(left) - a], np.array(window, np.uint32), right[b:]])
            width *= 2

    def join(self, left: Node, right: Node) -> Node:
        """The node of the two texts put together."""
        if not left.text or not right.text:
            return left if left.text else right
        cut, back = len(left.text), 2
        ends_left = np.append(left.starts[1:], cut)
        right_starts = right.starts.tolist()
        boundaries = {*right_starts, len(right.text)}
        while True:
            k = max(0, len(left.starts) - back)
            while k and left.starts[k] > cut - LOOK_AHEAD:
                k -= 1
            start = int(left.starts[k])
            tail = left.text[start:]
            window, pieces, at = tail + right.text, [], 0
            while True:
                end = self.pattern.match(window, at).end()
                pieces.append((at, end))
                at, x = end, end - len(tail)
                if x in boundaries:
                    break
            if k == 0 or pieces[0][1] == ends_left[k] - start and len(pieces) > 1:
                break
            back *= 2
        keep_right = bisect_left(right_starts, x)
        ids, counts = [], []
        for a, b in pieces:
            if a < len(tail) < b and a + start == left.starts[-1] and b - len(tail) == (right_starts[1] if len(right_starts) > 1 else len(right.text)):
                n = right.first[1] if len(right_starts) > 1 else len(right.ids)
                ids.append(self.join_tokens(left.ids[left.first[-1] :], right.ids[:n]))
            else:
                ids.append(np.array(self._piece(window[a:b].encode()), np.uint32))
            counts.append(len(ids[-1]))
        cut_left = int(left.first[k])
        cut_right = int(right.first[keep_right]) if keep_right < len(right_starts) else len(right.ids)
        counts = np.array(counts, np.int64)
        return Node(
            left.text + right.text,
            np.concatenate([left.starts[:k], np.array([a + start for a, _ in pieces], np.int64), right.starts[keep_right:] + cut]),
            np.concatenate([left.first[:k], np.cumsum(counts) - counts + cut_left, right.first[keep_right:] - cut_right + cut_left + counts.sum()]),
            np.concatenate([left.ids[:cut_left], *ids, right.ids[cut_right:]]),
        )

    def join_all(self, nodes: list[Node]) -> Node:
        """Join neighbours level by level."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]


@functools.lru_cache(maxsize=4)
def codec(path: str = DEFAULT_VOCABULARY) -> Codec:
    """The codec of a vocabulary file, made once in each Python worker."""
    return Codec(path)
