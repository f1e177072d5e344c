"""Repairing text of scanned pages: furniture, broken words, misread characters, reflow.

A page's lines are told apart by their form and their neighbours: running titles, page numbers, body. Words broken at
the end of a line are joined where the joined word is known and the compound with a hyphen is not. A word that is not
known well is looked up in a trie of the vocabulary by a Levenshtein automaton: a plain edit costs one, a confusion of
scanners half. A word counts as misread if a word that is far more frequent explains it by confusions alone; or, where
the word is rare, by an edit as well if the words beside it in the text stand beside that candidate elsewhere. Candidates
are ranked by kind and cost, then by how often the word's neighbours stand beside them, then by frequency in the
language of the text.

Each distinct text is parsed once; what a page holds is written and everything else runs on that. The vocabulary is
counted over all distinct texts and looked up once per distinct word, in parts of bounded size that tasks share out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.session import Scratch

SCANNED = ("ocr_text", "extracted_text")

# What a scanner reads, and the characters it may have been.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("é", "e"), ("0", "o"), ("o", "0"), ("1", "i"), ("1", "l"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"),
    ("5", "s"), ("s", "5"), ("8", "b"), ("9", "g"), ("g", "q"), ("q", "g"), ("b", "h"), ("h", "b"), ("v", "y"), ("y", "v"), ("2", "z"), ("6", "b"),
    ("ri", "n"), ("rl", "n"), ("n", "ri"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("li", "u"), ("il", "u"), ("u", "ii"),
    ("vv", "w"), ("w", "vv"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("nn", "m"), ("m", "nn"),
    ("@", "a"), ("|", "l"), ("|", "i"),
]

# Frequent words that tell the language of a text.
LANGUAGE_WORDS = {
    "en": "the and of our this that every each another some was were in to with",
    "de": "der die und ein unser dieser jener mancher jeder ihr ist nicht zwischen wenn aber",
    "es": "el la un este ese aquel nuestro cada otro su para porque cuando pero con",
    "fr": "le la un ce cet notre chaque autre quelque leur pour parce quand mais avec les des",
}
_LANGUAGES = {w: [k for k, v in LANGUAGE_WORDS.items() if w in v.split()] for v in LANGUAGE_WORDS.values() for w in v.split()}

_CHAR = r"(?:[^\W_]|[@|])"
WORD = re.compile(rf"[@|]*[^\W_]{_CHAR}*")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = "-‐¬\u00ad"
_BROKEN = re.compile(rf"({_CHAR}+)([-‐¬\u00ad])\s*$")
_FIRST = re.compile(rf"\s*({_CHAR}+)")
_COMPOUND = re.compile(r"(?<![\w/.-])([^\W\d_]+)[-‐]([^\W\d_]+)(?![\w/-])")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMERAL = rf"(?:[\dlIOoSsB|]*\d[\dlIOoSsB|]*|[lIO|]{{1,4}}|{_ROMAN}|{_ROMAN.upper()})"
_DECORATED = re.compile(rf"(?:\[\s*{_NUMERAL}\s*\]|\(\s*{_NUMERAL}\s*\)|[-–—]\s*{_NUMERAL}\s*[-–—]|(?:p|pp|pag|pág|s)\.\s*{_NUMERAL}|(?:page|seite|página|pagina)\s+{_NUMERAL}(?:\s*(?:of|von|de|sur|/)\s*{_NUMERAL})?)", re.I)
_PLAIN = re.compile(_NUMERAL)
_NUMBERED = re.compile(rf"(?:(?P<a>{_DECORATED.pattern}|{_NUMERAL})\s{{2,}}(?P<t>.*\S)|(?P<u>.*\S)\s{{2,}}(?P<b>{_DECORATED.pattern}|{_NUMERAL}))", re.I)


def is_title(line: str) -> bool:
    """Two words or more, each with a capital (or a digit that may stand for one) in front, and no end of a sentence."""
    if not line or line[-1] in ".!?,;:" or "/" in line or "_" in line:
        return False
    found = WORD.findall(line)
    return len(found) >= 2 and all(w[0].isupper() or ((w[0].isdigit() or w[0] in "@|") and not w.isdigit()) for w in found)


def _value(numeral: str) -> int | None:
    digits = re.sub(r"[\[\]().\s–—-]", "", numeral)
    digits = re.sub(r"^(?:pp|p|pag|pág|s|page|seite|página|pagina)", "", digits, flags=re.I)
    digits = re.split(r"of|von|de|sur|/", digits)[0]
    if not re.fullmatch(_ROMAN, digits, re.I):
        digits = digits.translate(str.maketrans("lIOoSsB|", "11005581"))
        return int(digits) if digits.isdigit() else None
    total, last = 0, 0
    for c in reversed(digits.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.get(c)
        if v is None:
            return None
        total += -v if v < last else v
        last = max(last, v)
    return total


class Page:
    """A text by lines: ``header`` and ``number`` hold the indices of furniture, ``body`` those of other lines with text."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.header: set[int] = set()
        self.number: set[int] = set()
        bare = [x.strip("\x0c \t\r") for x in self.lines]
        plain: list[int] = []
        for n, line in enumerate(bare):
            if not line:
                continue
            if _DECORATED.fullmatch(line):
                self.number.add(n)
            elif _PLAIN.fullmatch(line):
                plain.append(n)
            elif is_title(line) or ((m := _NUMBERED.fullmatch(line)) and is_title(m["t"] or m["u"])):
                self.header.add(n)
        skeletons = [_LETTERS.findall(x.lower()) for x in bare]
        repeated = Counter(map(" ".join, skeletons))
        for n, line in enumerate(bare):  # a title in small letters runs as well
            if len(skeletons[n]) >= 2 and repeated[" ".join(skeletons[n])] >= 3 and line[-1] not in ".!?,;:" and n not in self.header and n not in self.number:
                self.header.add(n)
        self._plain_numbers(bare, plain)
        self.body = [n for n, line in enumerate(bare) if line and n not in self.header and n not in self.number]

    def _plain_numbers(self, bare: list[str], plain: list[int]) -> None:
        """Bare numbers stand alone or indented; columns of figures stand one below the other.

        A number at an edge of a column is the page's if it goes on from the page numbers before it.
        """
        chosen = set(plain)
        alone = [n for n in plain if self.lines[n].strip("\x0c")[:4].isspace() or (n - 1 not in chosen and n + 1 not in chosen)]
        known = {n: _value(bare[n]) for n in alone}
        for n in plain:
            if n in known or (n - 1 in chosen and n + 1 in chosen and n - 1 not in known and n + 1 not in known):
                continue
            value = _value(bare[n])
            before = max((k for k in known if k < n), default=None)
            after = min((k for k in known if k > n), default=None)
            fits = [before is not None and known[before] is not None and value == known[before] + 1, after is not None and known[after] is not None and value == known[after] - 1]
            if value is not None and (all(fits) or (any(fits) and (before is None or after is None))):
                known[n] = value
        if len(known) >= 3:  # of three numbers or more, those that fit no other are figures
            values = list(known.items())
            known = {n: v for n, v in values if n not in alone or self.lines[n][:4].isspace() or any(v is not None and w is not None and m != n and (v - w) * (n - m) > 0 and abs(v - w) <= 3 for m, w in values)}
        self.number.update(known)

    def breaks(self) -> dict[int, tuple[str, str, str, int]]:
        """Body lines that end with a mark within a word: (left, mark, right, line of the right part)."""
        out = {}
        for n, after in zip(self.body, self.body[1:]):
            if self.lines[n].rstrip()[-1:] not in _MARKS:
                continue
            m, first = _BROKEN.search(self.lines[n]), _FIRST.match(self.lines[after].lstrip("\x0c"))
            if m and first and not m[1].isdigit() and not first[1].isdigit():
                out[n] = (m[1], m[2], first[1], after)
        return out

    def tokens(self, broken: dict) -> list[tuple[int, str]]:
        """(line, word) of the body, in lower case, without the parts of broken words."""
        skip = {after for *_, after in broken.values()}
        out = []
        for n in self.body:
            line = self.lines[n]
            start = _FIRST.match(line.lstrip("\x0c")).end() + len(line) - len(line.lstrip("\x0c")) if n in skip else 0
            end = _BROKEN.search(line).start() if n in broken else len(line)
            out += [(n, w.lower()) for w in WORD.findall(line, start, max(start, end))]
        return out


def language(words: list[str]) -> str:
    votes = Counter(k for w in words for k in _LANGUAGES.get(w, ()))
    return min(votes, key=lambda k: (-votes[k], k)) if votes else "en"


# ---- vocabulary and lookup ----


_PARSED = """h binary, scanned boolean, lang string, header array<int>, number array<int>, b_line array<int>, b_left array<string>, b_mark array<string>,
b_right array<string>, b_after array<int>, lines array<int>, words array<string>, c_what array<string>, c_lang array<string>, c_word array<string>, c_n array<bigint>"""
_COLUMNS = [x.split()[0] for x in _PARSED.replace("\n", " ").split(", ")]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per text with what its page holds, and a row per batch with its counts: words, broken words, their parts and compounds by language."""
    for batch in batches:
        seen: Counter = Counter()
        out = []
        for h, scanned, text in zip(batch["h"], batch["scanned"], batch["text"]):
            if scanned:
                page = Page(text)
                broken = page.breaks()
                tokens = page.tokens(broken)
                found = [w for _, w in tokens]
                lang = language(found)
                body = [page.lines[n] for n in page.body]
                parts = [(n + 1, a, mark, b, after + 1) for n, (a, mark, b, after) in broken.items()]
                seen.update(("broken", lang, (a + b).lower()) for _, a, _, b, _ in parts)
                seen.update(("part", lang, w.lower()) for _, a, _, b, _ in parts for w in (a, b))
                columns = list(zip(*parts)) or [[]] * 5
                out.append((h, True, lang, [n + 1 for n in sorted(page.header)], [n + 1 for n in sorted(page.number)], *map(list, columns), [n + 1 for n, _ in tokens], found, None, None, None, None))
            else:
                found, body = [w.lower() for w in WORD.findall(text)], text.split("\n")
                lang = language(found)
                out.append((h, False, lang, None, None, None, None, None, None, None, None, found, None, None, None, None))
            seen.update({("word", lang, w): n for w, n in Counter(found).items() if not w.isdigit()})
            seen.update(("compound", lang, f"{a}-{b}".lower()) for line in body if "-" in line or "‐" in line for a, b in _COMPOUND.findall(line))
        if seen:
            what, lang, word = map(list, zip(*seen))
            out.append((*[None] * 12, what, lang, word, list(seen.values())))
        yield pd.DataFrame(out, columns=_COLUMNS)


class Trie:
    """Words with a rank each, to be searched with an edit budget. A node is a dict; the key "" holds the word's number."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for k, word in enumerate(words):
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = k

    def candidates(self, word: str, budget: float = 2.0) -> dict[int, tuple[float, int, tuple]]:
        """The words within the budget: number to (cost, plain edits, confusions).

        A confusion costs half an edit; one plain edit (a character more, less or other) is allowed. A confusion is told
        as (place, length read, true characters). The states are those of the automaton: a node of the trie, how much of
        the word is read, and whether the plain edit is spent.
        """
        found: dict[int, tuple[float, int, tuple]] = {}
        best: dict[tuple[int, int, int], float] = {}
        work: list[tuple[dict, int, float, int, tuple]] = [(self.root, 0, 0.0, 0, ())]
        size = len(word)
        while work:
            node, i, cost, plain, path = work.pop()
            state = (id(node), i, plain)
            if best.get(state, 99.0) <= cost:
                continue
            best[state] = cost
            if i == size:
                k = node.get("")
                if k is not None and (k not in found or (cost, plain) < found[k][:2]):
                    found[k] = (cost, plain, path)
            else:
                after = node.get(word[i])
                if after is not None:
                    work.append((after, i + 1, cost, plain, path))
                if cost + 0.5 <= budget:
                    for read, true in _BY_FIRST.get(word[i], ()):
                        if word.startswith(read, i):
                            at = node
                            for c in true:
                                at = at.get(c)
                                if at is None:
                                    break
                            else:
                                work.append((at, i + len(read), cost + 0.5, plain, (*path, (i, len(read), true))))
            if not plain and cost + 1 <= budget:
                if i < size:
                    work.append((node, i + 1, cost + 1, 1, path))
                for c, after in node.items():
                    if c:
                        work.append((after, i, cost + 1, 1, path))
                        if i < size and c != word[i]:
                            work.append((after, i + 1, cost + 1, 1, path))
        return found


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _read, _true in CONFUSIONS:
    _BY_FIRST.setdefault(_read[0], []).append((_read, _true))


class Vocabulary:
    """How often words occur, in all and by language, with the trie over them."""

    def __init__(self, rows: Iterator[tuple[str, str, int]]):
        self.total: Counter = Counter()
        self.by: dict[str, dict[str, int]] = {}
        for lang, word, n in rows:
            self.total[word] += n
            self.by.setdefault(word, {})[lang] = n
        self.words = sorted(self.total)
        self.trie = Trie(self.words)

    def correct(self, word: str, own: int, ratio: float, least: int, shortest: int = 4) -> list[tuple]:
        """(correction, its count in all, cost, plain edits, confusions) of whatever may explain the word.

        A digit among letters needs no more than a known word; other words need one ``ratio`` times as frequent as
        themselves. An edit that is no confusion can only explain a word of ``shortest`` letters or more that occurs
        less than ``least`` times, and never by adding to a word or taking from it at its end, as inflections do.
        """
        mixed = any(c.isdigit() or c in "@|" for c in word) and not word.isdigit()
        need = least if mixed else max(least, ratio * own)
        edits = own < least and len(word) >= shortest
        fits = []
        for k, (cost, plain, path) in self.trie.candidates(word).items():
            w = self.words[k]
            if w == word or self.total[w] < need:
                continue
            if plain == 0 and path:
                fits.append((w, self.total[w], cost, 0, path))
            elif plain and edits and self.total[w] >= ratio * max(1, own) and not w.startswith(word[:-2]):
                fits.append((w, self.total[w], cost, 1, path))
        return fits


def _look_up(ratio: float, least: int):
    def run(vocabulary: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(vocabulary):
            known = Vocabulary(zip(vocabulary["lang"], vocabulary["word"], vocabulary["n"]))
            for word, langs, own in zip(asked["word"], asked["langs"], asked["own"]):
                for w, n, cost, plain, path in known.correct(word, int(own), ratio, least):
                    places, sizes = [p for p, _, _ in path], [size for _, size, _ in path]
                    out += [(word, lang, w, known.by[w].get(lang, 0), n, cost, plain, places, sizes) for lang in langs]
        return pd.DataFrame(out, columns=_LOOKED) if out else _NO_LOOKUPS

    return run


_LOOKUP = "word string, lang string, correction string, there bigint, n bigint, cost double, plain int, places array<int>, sizes array<int>"
_LOOKED = ["word", "lang", "correction", "there", "n", "cost", "plain", "places", "sizes"]
_NO_LOOKUPS = pd.DataFrame({c: pd.Series([], dtype=object) for c in _LOOKED})


class ScannedTexts:
    """Vocabulary and corrections of a table of representations: ``id, kind, text``.

    Texts of the kinds in ``SCANNED`` are repaired, those of other kinds only add to the vocabulary. Null ids, kinds and
    texts are left out; repeated rows give their defects once, and a text adds to the vocabulary once, however many copies
    of it there are; other columns are ignored; an empty table gives none.
    ``ratio`` and ``least``: how much more frequent than a word its correction must be, and how frequent at least.
    ``support``: how often a candidate of a plain edit must have been seen beside the word's neighbours.
    ``part_words``: words of a trie; a larger vocabulary is searched in parts. ``well_known``: how many of the most
    frequent words without a correction are sent to all tasks, so that their occurrences need no shuffle; this changes
    no result.
    """

    def __init__(self, texts: DataFrame, ratio: float = 12.0, least: int = 3, support: int = 3, part_words: int = 300_000, asked_words: int = 20_000, well_known: int = 100_000):
        spark = texts.sparkSession
        self.scratch = Scratch(spark)
        self.support = support
        rows = texts.select("id", F.col("kind").isin(*SCANNED).alias("scanned"), "text").where(F.col("id").isNotNull() & F.col("kind").isNotNull() & F.col("text").isNotNull())
        self.rows = rows.withColumn("h", F.unhex(F.md5("text")))
        # A copied text counts once, else its misread words come out as frequent as the words they stand for.
        self.once = rows.select("scanned", "text").distinct().withColumn("h", F.unhex(F.md5("text")))
        self.parsed = self.scratch.write(self.once.mapInPandas(_parse, _PARSED))
        counted = self.parsed.where(F.col("c_what").isNotNull()).select(F.explode(F.arrays_zip("c_what", "c_lang", "c_word", "c_n")).alias("c"))
        counts = counted.groupBy(F.col("c.c_what").alias("what"), F.col("c.c_lang").alias("lang"), F.col("c.c_word").alias("word")).agg(F.sum("c.c_n").alias("n"))
        counts = self.scratch.write(counts)
        totals = self.scratch.write(counts.where(F.col("what") == "word").groupBy("word").agg(F.sum("n").alias("own"), F.max_by("lang", F.struct("n", "lang")).alias("usual")))
        looked = self._looked_up(counts, totals, ratio, least, part_words, asked_words)
        sure = looked.where(F.col("plain") == 0)
        best = F.struct("cost", (-F.col("there")).alias("there"), (-F.col("n")).alias("n"), "correction")
        hits = self.scratch.write(sure.groupBy("word", "lang").agg(F.min(best).alias("c")).select("word", "lang", "c.correction"))
        # A correction may be a frequent misreading itself: then its own correction is meant, that of the language where
        # the misreading is usual if it does not occur in the text's.
        further = hits.select(F.col("word").alias("w"), F.col("lang").alias("k"), F.col("correction").alias("meant"))
        usual = further.join(totals.select(F.col("word").alias("w"), F.col("usual").alias("k")), ["w", "k"]).select(F.col("w").alias("v"), F.col("meant").alias("usually"))
        meant = sure.join(further, (F.col("correction") == F.col("w")) & (F.col("lang") == F.col("k")), "left").join(usual, F.col("correction") == F.col("v"), "left")
        meant = meant.withColumn("correction", F.coalesce("meant", "usually", "correction"))
        edited = looked.where(F.col("plain") == 1).join(hits, ["word", "lang"], "left_anti").join(hits.select(F.col("word").alias("correction")).distinct(), "correction", "left_anti")
        fits = meant.select(*_LOOKED).unionByName(edited.select(*_LOOKED))
        # All candidates of a word: it has as many as the vocabulary has words so near to it.
        self.fits = self.scratch.write(fits.groupBy("word", "lang").agg(F.collect_list(F.struct("plain", "cost", "there", "n", "correction", "places", "sizes")).alias("fits")))
        self.numbers = self.scratch.write(counts.where(F.col("what").isin("word", "part", "broken") & is_misread_number(F.col("word"))).select("word", "lang").distinct())
        self.clean = self.scratch.write(totals.where(F.col("own") >= least).join(hits.select("word").distinct(), "word", "left_anti").select("word", "own"))
        self.frequent = self.clean.orderBy(F.desc("own"), "word").limit(well_known).select("word")
        self.compounds = counts.where(F.col("what") == "compound").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("word")
        self.broken = self.scratch.write(self._broken())
        self.doubtful = self.scratch.write(self._doubtful())
        self.chosen = self.scratch.write(self._chosen())

    @staticmethod
    def _for_all(keys: DataFrame, most: int = 500_000) -> DataFrame:
        """A written table of short keys, to be sent to all tasks if it has few rows; else joins shuffle."""
        return F.broadcast(keys) if keys.count() <= most else keys

    def _looked_up(self, counts: DataFrame, totals: DataFrame, ratio: float, least: int, part_words: int, asked_words: int) -> DataFrame:
        # Each word with the languages of the texts it stands in; a broken word need not occur whole, its parts must.
        asked = counts.where(F.col("what") != "compound").groupBy("word").agg(F.collect_set("lang").alias("langs"), F.bool_or(F.col("what") == "broken").alias("broken"))
        asked = self.scratch.write(asked.join(totals, "word", "left").where(F.col("own").isNotNull() | F.col("broken")).select("word", "langs", F.coalesce("own", F.lit(0)).alias("own")))
        # Words of letters that occur often enough to be a correction, in parts that fit one trie.
        fit = counts.where(F.col("what") == "word").join(totals.where((F.col("own") >= least) & ~F.col("word").rlike(r"[\d@|]")).select("word"), "word").select("lang", "word", "n")
        parts = totals.where(F.col("own") >= least).count() // part_words + 1
        tasks = max(int(self.once.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts * (asked.count() // asked_words + 1))
        salts = -(-tasks // parts)
        # Every part meets every asked word: words are shared out over the salts, each of which has a copy of the part.
        fit = fit.select("*", F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        asked = asked.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int").alias("salt"))
        key = ["part", "salt"]
        both = fit.repartition(tasks, *key).groupBy(*key).cogroup(asked.repartition(tasks, *key).groupBy(*key))
        return self.scratch.write(both.applyInPandas(_look_up(ratio, least), _LOOKUP))

    def _broken(self) -> DataFrame:
        """Words parted by the end of a line: ``h, lang, line_no, left, right, after``, and ``is_break``: the mark is not the word's own hyphen."""
        rows = self.parsed.where(F.size("b_line") > 0).select("h", "lang", F.explode(F.arrays_zip("b_line", "b_left", "b_mark", "b_right", "b_after")).alias("b"))
        rows = rows.select("h", "lang", F.col("b.b_line").alias("line_no"), F.lower("b.b_left").alias("left"), F.col("b.b_mark").alias("mark"), F.lower("b.b_right").alias("right"), F.col("b.b_after").alias("after"))
        rows = rows.withColumns({"whole": F.concat("left", "right"), "compound": F.concat_ws("-", "left", "right")})
        for column in ("whole", "left", "right"):
            rows = rows.join(self.clean.select(F.col("word").alias(f"w_{column}")), F.col(column) == F.col(f"w_{column}"), "left")
        rows = rows.join(self.compounds.select(F.col("word").alias("w_compound")), F.col("compound") == F.col("w_compound"), "left")
        has = lambda column: F.col(f"w_{column}").isNotNull()
        told = F.when(has("whole"), ~has("compound")).when(has("compound"), False).otherwise(F.col("mark").isin("¬", "\u00ad") | ~(has("left") & has("right")))
        return rows.select("h", "lang", "line_no", "left", "right", "after", told.alias("is_break"))

    def _doubtful(self) -> DataFrame:
        """Occurrences of words that have candidates: ``h, line_no, word, at, other, before, behind, fits``; misread numbers without.

        For a broken word ``at`` is the length of its left part and ``other`` the line of its right part.
        """
        words, lines = F.col("words"), F.col("lines")
        tokens = self.parsed.where("scanned").select("h", "lang", words, F.posexplode(F.arrays_zip("words", "lines")).alias("pos", "t"))
        plain = tokens.select("h", "lang", F.col("t.lines").alias("line_no"), F.col("t.words").alias("word"), F.length("t.words").alias("at"), F.lit(0).alias("other"), F.get("words", F.col("pos") - 1).alias("before"), F.get("words", F.col("pos") + 1).alias("behind"))
        nothing = F.lit(None).cast("string")
        whole = self.broken.where("is_break").select("h", "lang", "line_no", F.concat("left", "right").alias("word"), F.length("left").alias("at"), F.col("after").alias("other"), nothing.alias("before"), nothing.alias("behind"))
        halves = self.broken.where(~F.col("is_break")).select("h", "lang", F.explode(F.array(F.struct(F.col("line_no"), F.col("left").alias("word")), F.struct(F.col("after").alias("line_no"), F.col("right").alias("word")))).alias("x"))
        halves = halves.select("h", "lang", "x.line_no", "x.word", F.length("x.word").alias("at"), F.lit(0).alias("other"), nothing.alias("before"), nothing.alias("behind"))
        # The frequent words are at most ``well_known``, so they may be sent to all tasks.
        rows = plain.unionByName(whole).unionByName(halves).join(F.broadcast(self.frequent), "word", "left_anti").where(~F.col("word").rlike(r"^\p{N}+$"))
        # Of the occurrences few have candidates: their keys decide first, so that the others meet no shuffle where the keys are few.
        asked = self._for_all(self.scratch.write(self.fits.select("word", "lang").unionByName(self.numbers)))
        rows = rows.join(asked, ["word", "lang"], "left_semi").join(self.fits, ["word", "lang"], "left")
        return rows.where(F.col("fits").isNotNull() | is_misread_number(F.col("word"))).select("h", "line_no", "word", "at", "other", "before", "behind", "fits")

    def _chosen(self) -> DataFrame:
        """The candidate of each doubtful word of a text: ``h, word, correction, places, sizes``."""
        asked = self.doubtful.where(F.col("fits").isNotNull())
        alone = (F.size("fits") == 1) & (F.element_at("fits", 1)["plain"] == 0)
        one = asked.where(alone).select("h", "word", F.element_at("fits", 1).alias("f")).dropDuplicates(["h", "word"]).select("h", "word", "f.correction", "f.places", "f.sizes")
        several = asked.where(~alone).select("h", "word", "before", "behind", F.explode("fits").alias("f"))
        pairs = several.select(F.explode(F.array(F.struct(F.col("before").alias("x"), F.col("f.correction").alias("y")), F.struct(F.col("f.correction").alias("x"), F.col("behind").alias("y")))).alias("p")).select("p.*")
        pairs = self._for_all(self.scratch.write(pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()))
        beside = self.parsed.where(F.size("words") > 1).select(F.explode(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p")).select("p.*")
        beside = self.scratch.write(beside.join(pairs, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.count("*").alias("seen")))
        several = several.withColumn("c", F.col("f.correction"))
        several = several.join(beside.select(F.col("x").alias("before"), F.col("y").alias("c"), F.col("seen").alias("s1")), ["before", "c"], "left")
        several = several.join(beside.select(F.col("x").alias("c"), F.col("y").alias("behind"), F.col("seen").alias("s2")), ["behind", "c"], "left")
        several = several.select("h", "word", "f", F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2"))
        rated = several.groupBy("h", "word", F.col("f.correction").alias("correction")).agg(F.min("f").alias("f"), F.sum(F.col("s1") + F.col("s2")).alias("support"), F.bool_or((F.col("s1") > 0) & (F.col("s2") > 0)).alias("framed"))
        rated = rated.where((F.col("f.plain") == 0) | (F.col("framed") & (F.col("support") >= self.support)))
        rank = F.struct("f.plain", "f.cost", -F.col("support"), -F.col("f.there"), -F.col("f.n"), "correction")
        best = rated.groupBy("h", "word").agg(F.min_by(F.struct("correction", "f.places", "f.sizes", "f.plain"), rank).alias("b"))
        # A plain edit has no place of its own: it counts for the line where the word begins.
        return one.unionByName(best.select("h", "word", "b.correction", F.when(F.col("b.plain") == 0, F.col("b.places")).otherwise(F.array(F.lit(0))).alias("places"), F.when(F.col("b.plain") == 0, F.col("b.sizes")).otherwise(F.array(F.lit(1))).alias("sizes")))

    def _by_id(self, rows: DataFrame, scanned: DataFrame) -> DataFrame:
        """``rows`` with one row per text ``h`` for each id of ``scanned`` (``id, h``). Texts of many copies are split."""
        many = scanned.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 100_000)
        # At most one text in a hundred thousand rows, so these may be sent to all tasks.
        many = F.broadcast(many.select("h", F.ceil(F.col("n") / 100_000).cast("int").alias("splits")))
        split = F.coalesce("splits", F.lit(1))
        copies = scanned.join(many, "h", "left").select("id", "h", F.pmod(F.xxhash64("id"), split).cast("int").alias("split"))
        each = rows.join(many, "h", "left").withColumn("split", F.explode(F.sequence(F.lit(0), split - 1))).drop("splits")
        return copies.join(each, ["h", "split"]).drop("h", "split")

    def defects(self) -> DataFrame:
        """``id, line_no, defect``: each faulty line once per kind of defect."""
        told = lambda column, name: self.parsed.where(F.size(column) > 0).select("h", F.explode(column).alias("line_no"), F.lit(name).alias("defect"))
        plain = told("header", "header").unionByName(told("number", "page_number"))
        plain = plain.unionByName(self.broken.where("is_break").select("h", "line_no", F.lit("break").alias("defect")))
        at, other = F.col("at"), F.col("other")
        left = F.exists("places", lambda p: p < at)
        right = F.exists(F.arrays_zip("places", "sizes"), lambda z: z["places"] + z["sizes"] > at)
        hit = self.doubtful.select("h", "word", "line_no", "at", "other").join(self.chosen, ["h", "word"], "left")
        number = F.col("correction").isNull() & is_misread_number(F.col("word"))
        lines = F.array_compact(F.array(F.when(left | number, F.col("line_no")), F.when((other > 0) & right, other)))
        misread = hit.select("h", F.explode(lines).alias("line_no"), F.lit("misread").alias("defect"))
        # The defects of a text are no more than four times its lines.
        rows = plain.unionByName(misread).distinct().groupBy("h").agg(F.collect_list(F.struct("line_no", "defect")).alias("found"))
        found = self._by_id(rows, self.rows.where("scanned").select("id", "h").distinct())
        return found.select("id", F.explode("found").alias("f")).select("id", "f.line_no", "f.defect").distinct()

    def repaired(self) -> DataFrame:
        """``id, text``: the paragraphs of each scanned text, without furniture, with words joined and corrected.

        Paragraphs part at blank lines; those around a page's furniture part none unless a sentence ends there.
        """
        fixes = self.chosen.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("word", "correction"))).alias("fixes"))
        parted = self.broken.where("is_break").groupBy("h").agg(F.collect_set("line_no").alias("parted"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                new = [reflow(t, dict(f) if f is not None else {}, set() if p is None else {n - 1 for n in p}) for t, f, p in zip(batch["text"], batch["fixes"], batch["parted"])]
                yield pd.DataFrame({"h": batch["h"], "text": new})

        scanned = self.once.where("scanned").join(fixes, "h", "left").join(parted, "h", "left").select("h", "text", "fixes", "parted")
        return self._by_id(scanned.mapInPandas(run, "h binary, text string"), self.rows.where("scanned").select("id", "h").distinct())


def is_misread_number(word):
    """A word of digits and letters that scanners take for digits, as a column."""
    return word.rlike(r"^(?=.*\d)(?=.*[a-z|])[0-9lo|]+$")


def _like(word: str, correction: str) -> str:
    if word.isupper() and len(word) > 1:
        return correction.upper()
    return correction[:1].upper() + correction[1:] if word[:1].isupper() else correction


def reflow(text: str, fixes: dict[str, str], within: set[int]) -> str:
    """The text's paragraphs with the words of ``fixes`` corrected; ``within`` are the lines that end within a word."""
    page = Page(text)
    broken = page.breaks()
    body = set(page.body)
    paragraphs: list[str] = []
    line_end, blank, furniture = "", True, False
    for n, line in enumerate(page.lines):
        if n not in body:
            blank = blank or not (n in page.header or n in page.number)
            furniture = furniture or n in page.header or n in page.number
            continue
        piece = line.strip("\x0c \t\r")
        glue = " "
        parted = blank and (not furniture or line_end[-1:] in ".!?:")
        if line_end.endswith("\0"):
            glue, parted = "", False
            paragraphs[-1] = paragraphs[-1][:-1]
        if n in broken:
            a, mark, b, _ = broken[n]
            stem = piece[: len(piece) - len(mark)]
            piece = (stem if n in within else stem + "-") + "\0"
        if parted or not paragraphs:
            paragraphs.append(piece)
        else:
            paragraphs[-1] += glue + piece
        line_end, blank, furniture = piece, False, False
    whole = "\n\n".join(p.rstrip("\0") for p in paragraphs)
    return WORD.sub(lambda m: _like(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], whole)
