"""Text garbled by a wrong character encoding: a table of garbled forms of the corpus's own words, joined with its tokens.

Every distinct clean token of the corpus is garbled under all encoding chains; a token of a document that equals such a form, and
can't be meant as it stands or is rarer than the word it would come from, is garbled, and the word is its original. A token that
frequency speaks against is garbled where a chain seen in the same document gives it. The table is as large as the vocabulary of
tokens with characters beyond ASCII, not as the corpus, and both joins are on the token.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import by_length
from quern.session import cut_lineage

#: Encodings that texts are written in, and that they are wrongly read in (fixed values).
WRITTEN_SINGLE = ("cp1252", "mac_roman", "cp850")
READ_SINGLE = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "iso8859_2", "iso8859_15", "koi8_r")
READ_MULTI = ("gbk", "big5", "shift_jis", "euc_kr")
TWICE = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")

_CJK = "⺀-鿿豈-﫿＀-￯"
WORD_TOKEN = r"(?<![A-Za-z])[A-Za-z]*[^\x00-\x7F][A-Za-z\x80-\U0010FFFF]*"
CLUSTER_TOKEN = r"[^\x00-\x7F]+"
PART_TOKEN = f"(?<=[{_CJK}])[^\\x00-\\x7F{_CJK}]+|[^\\x00-\\x7F{_CJK}]+(?=[{_CJK}])"
#: A lone character between blanks, one before a capitalised word, and one at the end of a word: kept apart by a mark in front.
LONE_TOKEN, OPENING_TOKEN = r"(?<![^\s])[^\x00-\x7F](?![^\s])", r"(?<![^\s(\[])[^\x00-\x7F](?=[A-Z][a-z])"
CLOSING_TOKEN = r"(?<=[A-Za-z.,!?])[^\x00-\x7F](?![^\s)\]])"
LONE, OPENING, CLOSING = "\x01", "\x02", "\x04"
MARKS = (LONE, OPENING, CLOSING)
#: Before a marked character that its whole text explains (with the reading after it), and before one beside other letters.
EXPLAINED, BESIDE = "\x03", "\x05"
#: Punctuation that single-byte encodings confuse with letters, and characters that every vocabulary knows (fixed values).
CONFUSED = "–—•…“”‘’«»"
ALWAYS_KNOWN = "–—•…“”‘’‚„†‡‰‹›€™−≤≥≠≈→←" + "".join(map(chr, [*range(0xA1, 0xAD), *range(0xAE, 0x180)]))
#: Signs that stand between letters or before a word as meant, and other signs of single-byte encodings that do neither (fixed values).
JOINING = CONFUSED + "·‚„‹›\xad‐‑―"
NEVER_LEADING = "¤¦¨ª¬¯²³´¶¸¹º¼½¾×÷ˆ˜˙˘˚˝˛ˇ"
#: Rows of garbled tokens (some 150 bytes each) that are broadcast at most.
FEW = 100_000
_NOT_CLEAN = re.compile("[�\x80-\x84\x86-\x9f]")
_ASCII = re.compile("[\x00-\x7f]")
_HAS_CJK = re.compile(f"[{_CJK}]")
_CHINESE = re.compile(f"[{_CJK}{CONFUSED}·]+")


def _table(encoding: str) -> str:
    """The 256 characters of a single-byte encoding, unassigned bytes as the control characters of the same number."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))


_TABLES = {e: _table(e) for e in (*READ_SINGLE, *WRITTEN_SINGLE)}


_MAPS = {e: {ord(c): b for b, c in enumerate(t)} for e, t in _TABLES.items()}


def _write(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def _read(data: bytes, encoding: str) -> str:
    if encoding in _TABLES:
        return codecs.charmap_decode(data, "strict", _TABLES[encoding])[0]
    return data.decode(encoding, "replace")


def garble(text: str, chain: str) -> str | None:
    """The form that a chain gives, None if the text can't be written so."""
    steps = chain.split(">")
    for written, read in zip(steps[::2], steps[1::2]):
        data = _write(text, written)
        if data is None:
            return None
        text = data.decode("cp1252", "replace") if read.endswith(" strict") else _read(data, read)
    return text


def garbled_forms(word: str) -> dict[str, str]:
    """Every form that differs from the word, with the first chain that gives it, such as 'utf_8>cp1252'."""
    forms: dict[str, str] = {}
    mark = word[0] if word[0] in MARKS else ""
    if mark:
        if word[1] in CONFUSED and (data := _write(word[1], "cp1252")):
            for read in READ_SINGLE[1:]:
                form = _read(data, read)
                if form != word[1] and not unicodedata.category(form).startswith("C"):
                    forms.setdefault(mark + form, f"cp1252>{read}")
        return forms

    def put(form: str, chain: str) -> None:
        if form != word and form not in forms:
            forms[form] = chain

    data = _write(word, "utf_8")
    if data is not None:
        for read in (*READ_SINGLE, *READ_MULTI):
            put(once := _read(data, read), f"utf_8>{read}")
            if read in TWICE:
                again = _write(once, "utf_8")
                for second in TWICE if read in TWICE[:2] else (read,):
                    put(twice := _read(again, second), f"utf_8>{read}>utf_8>{second}")
                    if read == second and read in TWICE[:2]:
                        put(_read(_write(twice, "utf_8"), read), f"utf_8>{read}>utf_8>{read}>utf_8>{read}")
        put(data.decode("ascii", "replace"), "utf_8>ascii")
        put(data.decode("cp1252", "replace"), "utf_8>cp1252 strict")
    data = _write(word, "gbk")  # has accented letters and typographic punctuation too
    if data is not None:
        for read in (*READ_SINGLE, *READ_MULTI, "utf_8", "ascii") if _HAS_CJK.search(word) else ("cp1252", "cp1251", "big5", "utf_8"):
            if read != "gbk":
                put(_read(data, read), f"gbk>{read}")
    for written in WRITTEN_SINGLE:
        data = _write(word, written)
        if data is not None:
            if "�" in (form := _read(data, "utf_8")):  # a strict reading as UTF-8 would undo a garbling
                put(form, f"{written}>utf_8")
            for read in (*READ_SINGLE, *READ_MULTI, "ascii"):
                if read != written:
                    put(_read(data, read), f"{written}>{read}")
    return forms


def _confusions() -> dict[str, dict[str, str]]:
    """For every reading that makes letters of them: what CONFUSED punctuation becomes, and what it was."""
    out = {}
    for read in READ_SINGLE[1:]:
        forms = {_read(_write(c, "cp1252"), read): c for c in CONFUSED}
        if any(unicodedata.category(f) in ("Lu", "Ll") for f in forms):
            out[read] = {f: c for f, c in forms.items() if f != c and not unicodedata.category(f).startswith("C")}
    return out


CONFUSIONS = _confusions()


def explaining(chars: set[str]) -> list[str]:
    """The readings that make punctuation of all characters beyond ASCII of a text: of a letter at least, or of two different characters."""
    enough = len(chars) > 1 or any(unicodedata.category(c) in ("Lu", "Ll") for c in chars)
    return [read for read, forms in CONFUSIONS.items() if enough and chars <= forms.keys()]


def _hash(form: str) -> int:
    """The engine's xxhash64 of a string."""
    value = xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), seed=42)
    return value - (1 << 64) if value >> 63 else value


def _all_chains() -> list[str]:
    read = [*READ_SINGLE, *READ_MULTI, "utf_8", "ascii", "cp1252 strict"]
    once = [f"{w}>{r}" for w in ("utf_8", "gbk", *WRITTEN_SINGLE) for r in read]
    twice = [f"utf_8>{a}>utf_8>{b}" for a in TWICE for b in TWICE]
    return [*once, *twice, *(f"utf_8>{a}>utf_8>{a}>utf_8>{a}" for a in TWICE)]


CHAINS = {chain: n for n, chain in enumerate(_all_chains())}


def _plausible(word: str, form: str) -> bool:
    """Whether a form says anything: one character in place of one, with no letters around, may be meant as it stands."""
    if form[0] in MARKS or "�" in form or _NOT_CLEAN.search(form):
        return True
    others = len(_ASCII.sub("", form))
    if len(form) > len(word) and others > 1:
        return True
    if _HAS_CJK.search(word):
        return len(word) > 1
    return len(_ASCII.findall(word)) >= 2


def _several(word: str, form: str, chain: str) -> bool:
    """Whether a form holds several characters in place of each, as nobody writes; two ideographs may happen to give a Cyrillic word."""
    if len(form) <= len(word):
        return False
    return chain.startswith("utf_8") or (chain.startswith("gbk") and len(word) > (2 if form.isalpha() and "\u0400" <= form[0] <= "\u04ff" else 1))


def _latin(c: str) -> bool:
    return c.isalpha() and c < "\u0250" and c not in "ªº"


def undone(token: str, written: str, reads: tuple[str, ...]) -> list[tuple[str, str]]:
    """(text, chain) for every one of the readings that loses nothing and gives the token from a text."""
    out = []
    for read in reads:
        try:
            data = codecs.charmap_encode(token, "strict", _MAPS[read])[0] if read in _MAPS else token.encode(read)
            text = data.decode(written)
        except UnicodeError:
            continue
        if text != token:
            out.append((text, f"{written}>{read}"))
    return out


def peeled(token: str) -> dict[str, str]:
    """Texts that one or two readings of UTF-8 in a single-byte encoding turn into the token, with the chain from there."""
    out: dict[str, str] = {}
    todo = [(token, "")] if token[:1] not in MARKS else []
    for _ in range(2):
        todo = [(text, f">{chain}{rest}") for t, rest in todo for text, chain in undone(t, "utf_8", READ_SINGLE) if not text.isascii()]
        for text, rest in todo:
            out.setdefault(text, rest)
    return out


def ideograph_pairs(text: str) -> set[str]:
    """The distinct pairs of neighbouring ideographs."""
    return {a + b for a, b in zip(text, text[1:]) if "\u3400" <= a <= "\u9fff" and "\u3400" <= b <= "\u9fff"}


def chinese_readings(token: str) -> list[tuple[str, str]]:
    """(text, first chain) for every Chinese run with neighbouring ideographs that a chain turns into the token."""
    if len(token) < 3 or not _CLUSTERS.fullmatch(token):
        return []
    reads = READ_MULTI if _HAS_CJK.search(token) else (*READ_SINGLE, *READ_MULTI)
    both = undone(token, "gbk", tuple(r for r in reads if r != "gbk")) + undone(token, "utf_8", reads)
    first: dict[str, str] = {}
    for text, chain in both:
        if _CHINESE.fullmatch(text) and ideograph_pairs(text):
            first.setdefault(text, chain)
    return list(first.items())


def oddity(token: str) -> int:
    """How many characters of a token can hardly be meant where they stand, whatever the frequency of the token.

    Replacement and control characters; signs between Latin letters, or leading ones that never lead; Latin letters that Western
    encodings lack, or capitals after small ones; Greek between Latin letters; Cyrillic letters and ideographs beside them; and
    runs that are UTF-8 read in another encoding.
    """
    if token[:1] in MARKS:
        return 0
    if any(len(c) > 1 and not _HAS_CJK.search(c) and undone(c, "utf_8", READ_SINGLE) for c in _CLUSTERS.findall(token)):
        return 7
    token, odd, signs, known = token[:1000], 0, 0, ""  # signs: so many stand since the character known
    for i, c in enumerate(token):
        before, after = token[i - 1] if i else "", token[i + 1 : i + 2]
        if _NOT_CLEAN.match(c):
            odd += 1
        elif c < "\x80" or c in JOINING or _latin(c):
            odd += signs if _latin(c) and _latin(known) else 0
            odd += _latin(c) and (("\xff" < c and c not in _TABLES["cp1252"]) or (c > "\x7f" and c.isupper() and before.islower()))
            signs, known = 0, c
        elif "\u0400" <= c <= "\u052f" or _HAS_CJK.match(c):
            odd += _latin(before) or _latin(after)
            signs, known = 0, c
        else:
            odd += (not i and c in NEVER_LEADING and _latin(after)) or (_latin(before) and "\xa1" <= after <= "\xbf")
            signs += 1
    return odd


_WORDS, _CLUSTERS, _PARTS = re.compile(WORD_TOKEN), re.compile(CLUSTER_TOKEN), re.compile(PART_TOKEN)
_MARKED = {LONE: re.compile(LONE_TOKEN), OPENING: re.compile(OPENING_TOKEN), CLOSING: re.compile(CLOSING_TOKEN)}


def _pieces(word: str) -> tuple[str, ...]:
    clusters = _CLUSTERS.findall(word)
    return tuple({word, *clusters, *(p for c in clusters for p in _PARTS.findall(c))})


def text_tokens(text: str, known: dict[str, tuple[str, ...]]) -> set[str]:
    """The distinct tokens of a text: runs beyond ASCII with and without the letters around them, and marked single characters.

    known keeps the pieces of words met before.
    """
    out: set[str] = set()
    for m in _WORDS.finditer(text):
        word = m[0]
        pieces = known.get(word)
        if pieces is None:
            pieces = known[word] = _pieces(word)
        out.update(pieces)
        if len(word) == 1 or (word[1:2].isascii() and word[0] > "\x7f"):
            start, end = m.span()
            if start == 0 or text[start - 1] in " \t\n\r\x0b\x0c([":
                if len(word) == 1:
                    if (start == 0 or text[start - 1] not in "([") and (end == len(text) or text[end] in " \t\n\r\x0b\x0c"):
                        out.add(LONE + word)
                elif "A" <= word[1] <= "Z" and "a" <= word[2:3] <= "z":
                    out.add(OPENING + word[0])
        if word[-1] > "\x7f" and (word[-2:-1].isascii() and (len(word) > 1 or text[m.start() - 1 : m.start()] in (".", ",", "!", "?"))):
            if m.end() == len(text) or text[m.end()] in " \t\n\r\x0b\x0c)]":
                out.add(CLOSING + word[-1])
    marked = [t for t in out if t[0] in MARKS and any(t[1] in forms for forms in CONFUSIONS.values())]
    if marked:
        chars = {c for c in text if c > "\x7f"}
        reads = explaining(chars)
        for t in marked:
            read = next((r for r in reads if t[1] in CONFUSIONS[r]), None)
            if read:
                out.add(EXPLAINED + t + read)
            elif any(c.isalpha() and c != t[1] for c in chars):
                out.add(BESIDE + t)
    return out


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, token), distinct within a row; ASCII texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in by_length(batches, "text", 4_000_000):
            if len(known) > 200_000:
                known.clear()
            ids, found = batch.column("doc_id").to_pylist(), []
            kept = []
            for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                if not text.isascii():
                    own = text_tokens(text, known)
                    found += own
                    kept += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field("doc_id").type), pa.array(found, pa.string())], names=["doc_id", "token"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, token string")


def _sided(df: DataFrame, rows: int) -> DataFrame:
    """`df` as a side of a join: broadcast if it has few rows, else joined by a shuffle.

    The engine's guess of a size counts neither what a function or an explode adds, nor what compression saves in a written table, so it
    would broadcast tables of many times its limit.
    """
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _chinese_by_pairs(vocabulary: DataFrame, clean: DataFrame) -> DataFrame:
    """(token, original, chain, df, original_df, level) of runs that a chain makes of Chinese whose pairs of ideographs the clean runs have.

    At least half of the pairs must be known: two of them, or the only one; three if ideographs would be made of ideographs.
    """

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = set().union(*map(ideograph_pairs, batch.column("token").to_pylist())) - seen
            seen |= new
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], names=["pair"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, df, o, c, sorted(ideograph_pairs(o))) for t, df in zip(batch.column("token").to_pylist(), batch.column("df").to_pylist()) for o, c in chinese_readings(t)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["token", "df", "original", "chain", "pairs"])

    known = clean.filter(F.col("token").rlike("[\\x{3400}-\\x{9FFF}]{2}")).select("token").mapInArrow(pairs_of, "pair string").distinct()
    runs = vocabulary.select("token", "df").mapInArrow(read, "token string, df bigint, original string, chain string, pairs array<string>")
    met = runs.withColumn("total", F.size("pairs")).withColumn("pair", F.explode("pairs")).join(known.hint("merge"), "pair").groupBy("token", "df", "original", "chain", "total").agg(F.count(F.lit(1)).alias("met"))
    least = F.when(F.col("token").rlike(f"[{_CJK}]"), 3).otherwise(F.least(F.lit(2), F.col("total")))
    best = met.filter((F.col("met") * 2 >= F.col("total")) & (F.col("met") >= least)).groupBy("token", "df").agg(F.max(F.struct((F.col("met") / F.col("total")).alias("share"), "met", "chain", "original")).alias("best"))
    return best.select("token", "best.original", "best.chain", "df", F.lit(None).cast("bigint").alias("original_df"), F.lit(2).alias("level"))


def garbled_vocabulary(pairs: DataFrame) -> DataFrame:
    """(token, original, chain, df, original_df, level) for each distinct token that may be garbled; original is null if none is known.

    level: 2 for what can't be meant; 1 for what might be, but is rarer than the original; 0 for what is no rarer, so that it takes
    a document with the chain to tell.
    """
    vocabulary = cut_lineage(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("h", F.xxhash64("token")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # forms travel as hashes and chains as numbers; the few that match get their texts back
        for batch in batches:
            columns: list[list[int]] = [[], [], [], []]
            for word, number, df in zip(*(batch.column(c).to_pylist() for c in ("token", "h", "df"))):
                odd = min(oddity(word), 7)
                for form, chain in garbled_forms(word).items():
                    if _plausible(word, form):
                        for column, value in zip(columns, (_hash(form), number, df, 16 * CHAINS[chain] + 2 * odd + _several(word, form, chain))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["h", "word_h", "original_df", "chain"])

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_hash(text), t, df, rest) for t, df in zip(batch.column("token").to_pylist(), batch.column("df").to_pylist()) for text, rest in peeled(t).items()]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["h", "token", "df", "rest"])

    always = [*ALWAYS_KNOWN, *(m + c for m in MARKS for c in CONFUSED)]
    clean = vocabulary.filter(~F.col("token").rlike("[\\x{FFFD}\\x80-\\x84\\x86-\\x9F]") & (~F.col("token").rlike(f"[{_CJK}]") | ~F.col("token").rlike("[A-Za-z]")))
    known = vocabulary.sparkSession.createDataFrame([(c, 0) for c in always], "token string, df bigint").withColumn("h", F.xxhash64("token"))
    sources = clean.unionByName(known)
    # a token gives some fifty forms, so the vocabulary, read from few files, is spread first
    spread = sources.repartition(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    forms = spread.mapInArrow(run, "h bigint, word_h bigint, original_df bigint, chain int")
    # a form of several characters in place of fewer can't be meant, nor can these characters alone, nor one odder than the word; of
    # equally odd ones, the form must be rarer than the word. A word odder than the form is no original
    oddness = F.pandas_udf(lambda tokens: tokens.map(lambda t: min(oddity(t), 7)).astype("int32"), "int")
    # what was read wrongly again, in any order of encodings, is joined by what the last readings were given
    again = vocabulary.select("token", "df").mapInArrow(peel, "h bigint, token string, df bigint, rest string")
    met = forms.hint("merge").join(vocabulary.withColumn("rest", F.lit("")).unionByName(again), "h").withColumn("odd", oddness("token")).withColumn("word_odd", F.floor(F.col("chain") / 2).cast("int") % 8)
    never_meant = (F.col("chain") % 2 == 1) | (F.col("rest") != "")
    marked = F.substring("token", 1, 1).isin(*MARKS)
    has_lost = F.col("token").contains("\ufffd")
    rarer = F.col("original_df") > F.col("df")
    usual = F.when(rarer, F.col("word_h"))
    best = (
        met.filter((F.col("rest") == "") | (F.col("chain") % 2 == 1))
        .filter(never_meant | (F.col("odd") >= F.col("word_odd")))
        .withColumn("level", F.when(marked, 0).when(never_meant | (F.col("odd") > F.col("word_odd")), 2).when(rarer, 1).otherwise(0))
        .groupBy("token", "df")
        .agg(
            F.max(F.struct("level", (has_lost & rarer).alias("rarer"), (-F.col("word_odd")).alias("even"), "original_df", "word_h", (F.col("rest") == "").alias("direct"), "chain", "rest")).alias("best"),
            F.coalesce(F.min(usual) == F.max(usual), (F.min("word_h") == F.max("word_h")) & F.col("token").rlike("[A-Za-z].*[A-Za-z]")).alias("sole"),
        )
        .select("token", "df", "best.*", (F.col("sole") | ~has_lost).alias("clear"))
        .filter((F.col("level") > 0) | ~F.col("token").rlike("[\\x{FFFD}\\x80-\\x84\\x86-\\x9F]"))
    )
    names = F.create_map(*[F.lit(x) for name, n in CHAINS.items() for x in (n, name)])
    originals = sources.select(F.col("h").alias("word_h"), F.col("token").alias("original")).distinct()
    # characters that were lost come back only if a single word fits what is left
    matched = best.join(originals, "word_h").select("token", F.when(F.col("clear"), F.col("original")).alias("original"), F.concat(F.element_at(names, F.floor(F.col("chain") / 16).cast("int")), "rest").alias("chain"), "df", "original_df", "level")
    matched = cut_lineage(matched)  # garbled tokens only, read several times below
    n = matched.count()
    # a word may itself be a form of another: what was garbled twice gets the first original
    matched, weak = matched.filter("level > 0"), matched.filter("level = 0")
    weak = weak.join(_sided(matched.filter("level = 2").select(F.col("token").alias("original")), n), "original", "left_anti").select(matched.columns)
    for _ in range(2):
        step = matched.select(F.col("token").alias("original"), F.col("original").alias("first"), F.col("chain").alias("before"))
        matched = matched.join(_sided(step, n), "original", "left").select(
            "token", F.coalesce("first", "original").alias("original"), F.when(F.col("first").isNull(), F.col("chain")).otherwise(F.concat_ws(">", "before", "chain")).alias("chain"), "df", "original_df", "level"
        )
    # Chinese runs are whole sentences, which need not stand clean elsewhere
    chinese = cut_lineage(_chinese_by_pairs(vocabulary, clean).join(_sided(matched.select("token"), n), "token", "left_anti"))
    n_chinese = chinese.count()
    weak = weak.join(_sided(chinese.select("token"), n_chinese), "token", "left_anti")
    known_tokens = matched.select("token").unionByName(chinese.select("token"))
    lost = vocabulary.filter(F.col("token").rlike("[\\x{FFFD}\\x80-\\x84\\x86-\\x9F]")).join(_sided(known_tokens, n + n_chinese), "token", "left_anti")
    none = F.lit(None)
    lost = lost.select("token", none.cast("string").alias("original"), none.cast("string").alias("chain"), "df", none.cast("bigint").alias("original_df"), F.lit(2).alias("level"))
    by = lambda df, name: df.withColumn("found_by", F.when(F.col("original").isNull(), "lost").otherwise(name))
    return by(matched, "form").unionByName(by(chinese, "pairs")).unionByName(by(weak, "form")).unionByName(by(lost, "lost"))


def garbled_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token, original, chain, found_by) for every garbled token of every document.

    found_by: 'form' for a form of a word of the corpus, 'pairs' for Chinese known by its pairs of ideographs, 'alone' for single
    characters that their whole document explains, 'lost' for replacement and control characters that no word explains.

    Tokens of single characters between blanks, before a capitalised word or at a word's end have one of MARKS in front. Null, empty
    and ASCII texts, rows without an id and unusual characters used as meant give no rows; replacement and control characters
    are garbled even where no original is known; repeated rows give the same rows again; other columns are ignored.
    """
    found = cut_lineage(tokens(docs, id_col, text_col))
    judged = F.substring("token", 1, 1).isin(EXPLAINED, BESIDE)
    pairs = found.filter(~judged)
    known = cut_lineage(garbled_vocabulary(pairs))
    met = cut_lineage(pairs.join(_sided(known, known.count()), "token").select("doc_id", "token", "original", "chain", "df", "level", "found_by"))
    gives = F.pandas_udf(lambda o, t, cs: pd.Series([any(garble(a, c) == b for c in some) for a, b, some in zip(o, t, cs)], dtype=bool), "boolean")

    def told(by: DataFrame) -> DataFrame:
        seen = by.filter(F.col("original").isNotNull()).groupBy("doc_id").agg(F.collect_set("chain").alias("chains"))
        shown = met.filter("level = 0").join(seen.hint("merge"), "doc_id").filter(gives("original", "token", "chains")).drop("chains")
        # a garbled passage beside clean text shows a chain too: at least half of a token's documents must
        often = shown.groupBy("token", "original").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df")).filter("2 * n >= df").select("token", "original")
        return shown.join(often, ["token", "original"], "left_semi")

    # a word rarer than its own garbled form is still the word if documents show which of the two is garbled
    sure = met.filter("level = 2")
    turned = told(sure).select(F.col("original").alias("token"), F.col("token").alias("original")).distinct()
    firm = sure.unionByName(met.filter("level = 1").join(turned, ["token", "original"], "left_anti"))
    return firm.unionByName(told(firm)).drop("level", "df").unionByName(_alone(found.filter(judged))).dropDuplicates(["doc_id", "token"])


def _alone(judged: DataFrame) -> DataFrame:
    """Single characters, marked, that nothing but punctuation read wrongly explains: all characters beyond ASCII of their document are such.

    What at least as many documents hold in the same place beside other letters is meant, such as the French à.
    """
    kind, mark, form = F.substring("token", 1, 1), F.substring("token", 2, 1), F.substring("token", 3, 1)
    rows = judged.select("doc_id", F.concat(mark, form).alias("token"), (kind == EXPLAINED).alias("garbled"), F.expr("substring(token, 4)").alias("read"))
    words = rows.groupBy("token").agg(F.count_if("garbled").alias("g"), F.count_if(~F.col("garbled")).alias("w")).filter(F.col("w") >= F.col("g"))
    was = F.create_map(*[F.lit(x) for read, forms in CONFUSIONS.items() for f, c in forms.items() for x in (f + read, c)])
    original = F.concat(F.substring("token", 1, 1), F.element_at(was, F.concat(F.substring("token", 2, 1), "read")))
    kept = rows.filter("garbled").join(words.select("token"), "token", "left_anti")
    return kept.select("doc_id", "token", original.alias("original"), F.concat(F.lit("cp1252>"), "read").alias("chain"), F.lit("alone").alias("found_by"))


def _undo(token: str, chains: set[str]) -> str | None:
    """The text that a chain seen elsewhere in the document garbles into exactly this token."""
    for chain in sorted(chains):
        steps, text = chain.replace(" strict", "").split(">"), token
        for written, read in reversed(list(zip(steps[::2], steps[1::2]))):
            try:
                data = codecs.charmap_encode(text, "strict", codecs.charmap_build(_TABLES[read]))[0] if read in _TABLES else text.encode(read)
                text = data.decode(written)
            except (UnicodeError, LookupError):
                text = None
                break
        if not text or text == token or _NOT_CLEAN.search(text):
            continue
        if (chain in garbled_forms(text).values() and garbled_forms(text).get(token)) if chain in CHAINS else garble(text, chain) == token:
            return text
    return None


def restored(text: str, found: dict[str, str | None], chains: set[str], alone: bool = False) -> tuple[str, int]:
    """The text with originals in place of garbled tokens, and how many garbled tokens stay; alone: some were found as 'alone'."""
    left = 0

    def part(m: re.Match) -> str:
        return found.get(m[0]) or m[0]

    def cluster(m: re.Match) -> str:
        nonlocal left
        token = m[0]
        meant = (token.isalpha() and len(token) == 1) or all(c in JOINING for c in token)  # as far as the token alone can tell
        new = found.get(token) or (None if meant else _undo(token, chains))
        if new:
            return new
        new = _PARTS.sub(part, token)
        left += bool(_NOT_CLEAN.search(new))
        return new

    def word(m: re.Match) -> str:
        return found.get(m[0]) or _CLUSTERS.sub(cluster, m[0])

    if alone and (reads := explaining({c for c in text if c > "\x7f"})):  # all of the text's characters beyond ASCII are punctuation read wrongly
        return text.translate({ord(a): b for a, b in CONFUSIONS[reads[0]].items()}), left
    text = _WORDS.sub(word, text)
    for mark, pattern in _MARKED.items():
        text = pattern.sub(lambda m: (found.get(mark + m[0]) or mark + m[0])[1:], text)
    return text, left


def restore_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored, n_garbled, n_left) for every document with garbled tokens.

    restored is the text with the original of each garbled token; a token whose word is nowhere in the corpus is undone by a chain
    seen in the same document, if garbling the result gives the token again. n_left counts runs that still hold replacement
    or control characters. Documents without garbled tokens give no rows.
    """
    by_doc = garbled_tokens(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_set(F.struct("token", "original", "chain", "found_by")).alias("found"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(by_doc, "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, found in frame.itertuples(index=False, name=None):
                new, left = restored(text, {f["token"]: f["original"] for f in found if f["original"]}, {f["chain"] for f in found if f["chain"]}, any(f["found_by"] == "alone" for f in found))
                out.append((doc_id, new, len(found), left))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "n_garbled", "n_left"])

    return rows.mapInPandas(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, restored string, n_garbled int, n_left int")
