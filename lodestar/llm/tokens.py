"""Token counts by prefix dynamic programming over the merges of a public tokenizer.

A byte-pair encoding of a string is the one cut into tokens in which each pair of neighbours is its own encoding. So the last
token of every prefix can be found from the prefixes before it: a token that ends there counts if the encoding of what stands
before it ends in a token that goes with it, and the count of the prefix is one more. Whether two tokens go together is asked
once and kept. The tokenizer marks the last token of a piece, so there are two tables: one of prefixes that go on, and
one of prefixes that end there, which is the answer.

The tokenizer cuts normalised text into pieces and merges inside pieces only. A text's table has the exact count of every
prefix, one entry for each character, so truncation and budget questions are lookups and nothing is encoded again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of these characters only (ASCII and Latin letters, no other spaces or marks) are in normal form, and ranges say what is a letter or number.
_ODD = re.compile("[^\t\n\r -~¡-ɏ]")
_LETTERS, _NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_CACHE = 400_000
#: Texts whose pieces are counted together.
TEXTS = 1000


def _bytes_as_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: its own if that can be seen, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """Encodings of short strings, which of the tokens that fit a place count there, and counts of all prefixes of a piece."""

    def __init__(self, merges: list, vocab: dict[str, int], suffix: str):
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.vocab, self.suffix, self.letters = vocab, suffix, _bytes_as_letters()
        #: What tokens that go on end with, and tokens at the end of a piece.
        self.tails = {t[i:] for t in vocab if not (suffix and t.endswith(suffix)) for i in range(len(t))}
        self.final_tails = {t[i:-len(suffix)] for t in vocab if t.endswith(suffix) for i in range(len(t) - len(suffix))} if suffix else self.tails
        self.text, self.last, self.n = "", [""], [0]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}

    def encoded(self, parts: list[str]) -> list[str]:
        """Joins the pair of least rank until none is left."""
        ranks = self.ranks.get
        while len(parts) > 1:
            found = [ranks(p, 1 << 60) for p in pairwise(parts)]
            rank = min(found)
            if rank == 1 << 60:
                break
            i = found.index(rank)
            a, b, out = parts[i], parts[i + 1], parts[:i]
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _letters_of(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def whole(self, token: str) -> bool:
        """Whether a token is the encoding of its own letters."""
        found = self.single.get(token)
        if found is None:
            found = token in self.vocab and self.encoded(self._letters_of(token)) == [token]
            if token in self.vocab:
                self.single[token] = found
        return found

    def together(self, a: str, b: str) -> bool:
        """Whether two tokens are the encoding of their letters."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= _CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.encoded([*a, *self._letters_of(b)]) == [a, b]
        return found

    def _final(self, text: str, i: int) -> int:
        """Tokens of a piece that ends after i letters of the text."""
        for j in range(i - 1, -1, -1):
            body = text[j:i]
            if body not in self.final_tails:
                break
            token = body + self.suffix
            if token in self.vocab and self.last[j] is not None and self.whole(token) and (not j or self.together(self.last[j], token)):
                return self.n[j] + 1
        raise ValueError(f"no token ends after {text[:i]!r}")

    def _go_on(self, text: str) -> None:
        """The last token and the count of each prefix that goes on; those of what the text shares with the one before are there already."""
        same = 0
        for x, y in zip(text, self.text, strict=False):
            if x != y:
                break
            same += 1
        self.text, last, n = text, self.last, self.n
        del last[same + 1 :], n[same + 1 :]
        for i in range(len(last), len(text)):
            last.append(None)  # None if no letter ends here
            n.append(0)
            for j in range(i - 1, -1, -1):
                token = text[j:i]
                if token not in self.tails:
                    break
                if token in self.vocab and last[j] is not None and self.whole(token) and (not j or self.together(last[j], token)):
                    last[i], n[i] = token, n[j] + 1
                    break
        # So far only prefixes shorter than the text; one that goes on from its end has another text.
        self.text = text[: len(last) - 1]

    def counts(self, piece: str, all_of: bool) -> list[int]:
        """Tokens of the prefixes of a piece, by characters from 1 on; of the whole piece alone without ``all_of``. Fast if pieces come in order."""
        if piece.isascii() and piece.isprintable():
            text, ends = piece, range(1, len(piece) + 1)
        else:
            coded = ["".join(self.letters[b] for b in c.encode("utf-8", "surrogatepass")) for c in piece]
            text, ends = "".join(coded), list(accumulate(map(len, coded)))
        if not all_of and text + self.suffix in self.vocab and self.whole(text + self.suffix):
            return [1]
        self._go_on(text)
        return [self._final(text, i) for i in (ends if all_of else ends[-1:])]


class PrefixCounter:
    """Prefix tables of texts for a tokenizer file; counts are kept for a bounded number of pieces."""

    def __init__(self, path: str):
        try:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            model, before = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
            cut, level = before
            good = model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges")
            good = good and (cut["type"], cut["behavior"], cut["invert"]) == ("Split", "Removed", True) and (level["type"], level["use_regex"], level["add_prefix_space"]) == ("ByteLevel", False, False)
            good = good and all(not a["single_word"] and not a["lstrip"] and not a["rstrip"] and not a["normalized"] for a in spec["added_tokens"])
        except (UnicodeDecodeError, json.JSONDecodeError, KeyError, TypeError, ValueError) as e:
            raise ValueError(f"{path} is not a tokenizer of words and byte-pair merges") from e
        if not good:
            raise ValueError(f"{path} cuts or merges text in a way that prefix tables don't know")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(model["merges"], model["vocab"], model.get("end_of_word_suffix") or "")
        pattern = cut["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.latin = re.compile(pattern.replace(r"[\p{L}]", f"[{_LETTERS}]").replace(r"[\p{N}]", f"[{_NUMBERS}]").replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS))
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Only this normal form is known to be lower case, and nothing else, for texts without odd characters.
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        self.lowers = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
        self.known: dict[str, int] = {}
        self.inside: dict[str, list[int]] = {}

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def parts(self, text: str) -> list[str]:
        """Stretches between special strings, which are at the odd places."""
        return self.specials.split(text) if self.specials else [text]

    def words(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if self.lowers and _ODD.search(text) is None:
            return self.latin.findall(text.lower())
        return self.pieces.findall(self.normal(text))

    def learn(self, pieces: set[str]) -> None:
        """Counts pieces that aren't known yet, in order, as neighbours share prefixes."""
        new = pieces - self.known.keys()
        if len(self.known) + len(new) > _CACHE:
            self.known.clear()
            new = pieces
        for piece in sorted(new):
            self.known[piece] = self.merges.counts(piece, False)[-1]

    def total(self, piece: str) -> int:
        n = self.known.get(piece)
        return self.merges.counts(piece, False)[-1] if n is None else n

    def prefixes(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, by characters from 1 on."""
        found = self.inside.get(piece)
        if found is None:
            if len(self.inside) >= _CACHE // 8:
                self.inside.clear()
            if piece.isalpha() or not any(map(str.isalpha, piece)):
                found = self.merges.counts(piece, True)
            else:  # a contraction is cut in another way where it isn't whole
                found = [sum(map(self.total, self.pieces.findall(piece[:i]))) for i in range(1, len(piece) + 1)]
            self.inside[piece] = found
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        out = []
        for at in range(0, len(texts), TEXTS):
            some = [self.parts(t) for t in texts[at : at + TEXTS]]
            cut = [[w for p in parts[::2] if p for w in self.words(p)] for parts in some]
            self.learn(set().union(*cut))
            out += [len(parts) // 2 + sum(map(self.known.__getitem__, words)) for parts, words in zip(some, cut, strict=True)]
        return out

    def table(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, tokens of each of its prefixes, the empty one first)."""
        out, base, whole, tail = [0], 0, [], ""
        for i, part in enumerate(self.parts(text)):
            if i % 2:
                # Until it is whole, a special string is text like any other and may go on with the piece before it.
                cut = self.plain(tail + part)[len(tail) + 1 :]
                before = base - (self.plain(tail)[-1] if tail else 0)
                base += 1
                out += [before + n for n in cut[:-1]] + [base]
                whole.append(part)
                tail = ""
            elif part:
                part = self.normal(part)
                out += [base + n for n in self.plain(part)[1:]]
                base = out[-1]
                whole.append(part)
                spans = [m.span() for m in self.pieces.finditer(part)]
                tail = part[spans[-1][0] :] if spans and spans[-1][1] == len(part) else ""
        return "".join(whole), np.array(out, np.int32)

    def plain(self, text: str) -> list[int]:
        """The table of a normalised text in which no special string is whole."""
        out, base = [0], 0
        for m in self.pieces.finditer(text):
            out += [base] * (m.start() + 1 - len(out))
            out += [base + n for n in self.prefixes(m.group())]
            base = out[-1]
        return out + [base] * (len(text) + 1 - len(out))

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of the normalised text that has no more tokens than the budget."""
        _, table = self.table(text)
        return int(np.flatnonzero(table <= budget)[-1])


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One for all tasks that a Python worker runs one after another, as they have many pieces in common."""
    return PrefixCounter(path)


def _tables(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for frame in frames:
            rows, held = [], 0
            for i, text in zip(frame["id"], frame["text"], strict=True):
                rows.append((i, *counter.table(text or "")))
                held += len(rows[-1][2])
                if held > 500_000:
                    yield pd.DataFrame(rows, columns=["id", "normal", "prefix_tokens"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["id", "normal", "prefix_tokens"])

    return run


def _totals(path: str, limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for frame in frames:
            texts = frame["text"].tolist()
            yield pd.DataFrame({"id": frame["id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": counter.count(texts)})

    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): ids as strings, since pandas would make floats of longs with nulls among them."""
    return docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _named(out: DataFrame) -> DataFrame:
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


def prefix_tables(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, normal string, prefix_tokens array<int>): the text as the tokenizer normalises it, and the tokens of each of its prefixes.

    Entry i is the count of the first i characters, so the table of a null or empty text is [0]. Prefixes are those of the normalised
    text, in which special strings stay as they are. Rows that repeat stay, rows with a null id too; other columns are ignored.
    ``tokens_total``, ``tokens_at``, ``chars_within`` and ``truncated`` answer questions from the table alone. A file that
    isn't a tokenizer of the kind known here (a split by a pattern, bytes as letters, merges) is refused with ValueError.
    """
    path = path or tokenizer_path()
    PrefixCounter(path)
    return _named(_rows(docs, id_col, text_col).mapInPandas(_tables(path), "id string, normal string, prefix_tokens array<int>"))


def tokens_total(table: str = "prefix_tokens"):
    """Tokens of the whole text."""
    return F.expr(f"coalesce(try_element_at({table}, -1), 0)")


def tokens_at(chars: int, table: str = "prefix_tokens"):
    """Tokens of the first ``chars`` characters; of all, if there are fewer."""
    return F.expr(f"coalesce(get({table}, greatest(0, least({chars}, size({table}) - 1))), 0)")


def chars_within(budget: int, table: str = "prefix_tokens"):
    """Characters of the longest prefix that fits into a budget of tokens."""
    return F.expr(f"coalesce(array_max(transform({table}, (n, i) -> if(n <= {budget}, i, 0))), 0)")


def truncated(budget: int, table: str = "prefix_tokens", text: str = "normal"):
    """The longest prefix itself."""
    return F.expr(f"left({text}, coalesce(array_max(transform({table}, (n, i) -> if(n <= {budget}, i, 0))), 0))")


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``) of each whole text: the last entry of its prefix table.

    Counts are those of the tokenizer's library without added special tokens; special strings inside texts are one
    token each, as is the library's default. Nulls, repeated rows, other columns and files as in :func:`prefix_tables`.
    """
    path = path or tokenizer_path()
    PrefixCounter(path)
    out = _rows(docs, id_col, text_col).mapInPandas(_totals(path, limit), "id string, n_bytes long, n_tokens long")
    return _named(out).withColumn("over_limit", F.col("n_tokens") > limit)
