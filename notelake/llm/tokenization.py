"""Public tokenizers inside executor tasks: ids of whole texts, long ones encoded in pieces that give the same ids."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np

_LETTER = "A-Za-z0-9\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3"
_POINT = "!-&(-/:-@\\[-`{-~\u3001\u3002\u300c-\u300f\uff01\uff08\uff09\uff0c\uff0e\uff1a\uff1b\uff1f"
#: Safe places to cut for the byte-level word pattern, which never looks back: where a word must end in front of a blank
#: or line end, between a letter or digit and punctuation, and between punctuation (no apostrophe, which may begin a
#: contraction) and a letter or digit. Both sides encode as they would together.
_SAFE = re.compile(rf"(?<=\S)(?=[ \n\r\t])|(?<=[{_LETTER}])(?=[{_POINT}])|(?<=[{_POINT}])(?=[{_LETTER}])")


def resolve(name: str) -> str:
    """A path as given, or a bare file name looked up in the installed package of public vocabularies."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of one text, or of a batch; special strings in the text as the library's default has them. cuttable: safe_pieces() holds, away from markers (the special strings)."""

    def __init__(self, batch: Callable[[list[str]], list], cuttable: bool = False, markers: tuple[str, ...] = ()) -> None:
        self.batch, self.cuttable, self.markers = batch, cuttable, markers

    def __call__(self, text: str) -> Sequence[int]:
        return self.batch([text])[0]


@functools.lru_cache(maxsize=8)
def encoder(name: str) -> Encoder:
    path = resolve(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Encoder(lambda texts: model.encode(texts, num_threads=1))
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if fast := _ranked(spec):
        return fast
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return Encoder(lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)])


def _ranked(spec: dict) -> Encoder | None:
    """The same byte-level BPE run from its ranks, several times faster; None for any other kind of tokenizer."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    added = spec.get("added_tokens") or []
    plain = (
        pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("unk_token")
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in added)
    )
    if not plain:
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if any(y <= x for x, y in zip(ids, ids[1:], strict=False)):
        return None  # a rank must order the merges
    import tiktoken

    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    core = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    markers = tuple(special)

    def batch(texts: list[str]) -> list[np.ndarray]:
        return [core.encode_to_numpy(t, allowed_special="all") for t in texts]

    return Encoder(batch, cuttable=True, markers=markers)


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if visible, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def safe_pieces(text: str, size: int, markers: tuple[str, ...] = ()) -> Iterator[str]:
    """The text in pieces of about size characters, cut only where the ids cannot change; an uncuttable stretch stays whole.

    No cut goes through an occurrence of a marker, so either side holds the markers that the whole text has there.
    """

    def inside(i: int) -> bool:
        return any(text.find(m, max(0, i - len(m) + 1), i + len(m) - 1) >= 0 for m in markers)

    start = 0
    while len(text) - start > size:
        cut = next((m.start() for m in _SAFE.finditer(text, start + size) if not inside(m.start())), None)
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_batches(encode: Encoder, texts: Iterable[str], batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> Iterator[tuple[int, list[Sequence[int]]]]:
    """(place, lists of ids) of the texts in order: the ids of a text's pieces, in batches of about batch_bytes.

    Long texts are cut into safe pieces and share batches with others; a text is given once its last piece is encoded.
    """
    held: list[tuple[int, str, bool]] = []
    done: list[Sequence[int]] = []
    size = 0

    def flush() -> Iterator[tuple[int, list[Sequence[int]]]]:
        nonlocal done
        for (i, _, last), ids in zip(held, encode.batch([p for _, p, _ in held]), strict=True):
            done.append(ids)
            if last:
                yield i, done
                done = []

    for i, text in enumerate(texts):
        pieces = [text] if len(text) <= piece_chars or not encode.cuttable else list(safe_pieces(text, piece_chars, encode.markers))
        for k, piece in enumerate(pieces, 1):
            held.append((i, piece, k == len(pieces)))
            size += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes:
                yield from flush()
                held, size = [], 0
    yield from flush()
