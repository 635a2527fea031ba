"""What the operators share: Arrow batches of bounded size, frozen tables, numbering, subword ids."""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import is_normalized, normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.session import work_path

#: lower-cases A-Z and leaves every other byte
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = b" \t\n\x0b\x0c\r"
#: rows that the JVM sends to Python at once, so that very long texts do not add up
ROWS_PER_BATCH = 256


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where the table already has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lets Arrow batches hold few rows; texts may be long.

    Plans are made later, so the session keeps the setting. It is the same for all operators, and a
    smaller one of the user's own stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS_PER_BATCH:
        conf.set(key, str(ROWS_PER_BATCH))
    return df


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts batches into slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        all_texts = texts(batch.column(column))
        start, size = 0, 0
        for i, text in enumerate(all_texts):
            if i > start and size + len(text) > most:
                yield batch.slice(start, i - start), all_texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(all_texts):
            yield batch.slice(start), all_texts[start:]


def word_lists(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between white space, in lists from about ``most`` bytes of a long text each."""
    if len(text) <= most:
        yield text.split()
        return
    start = 0
    while start < len(text):
        end = text.find(b" ", start + most)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def frozen(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so later plans see the same rows."""
    path = work_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, label: str, group: str, row: str) -> tuple[DataFrame, DataFrame]:
    """Adds ``row``, a gapless number from 0 within ``group``, without gathering a group.

    Rows are frozen with the id of the task that wrote them; every (group, task) is
    numbered by itself and starts where the tasks before it end. Returns the numbered
    rows and the number of rows per group.
    """
    rid, part, first, n = fresh(df, "_rid", "_part", "_first", "_n")
    kept = frozen(df.withColumn(rid, F.monotonically_increasing_id()), label)
    kept = kept.withColumn(part, F.shiftright(rid, 33))
    counts = kept.groupBy(group, part).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(
        F.col(group).alias("_g"), F.col(part).alias("_p"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first)
    )
    inside = F.row_number().over(W.partitionBy(group, part).orderBy(rid)) - 1
    rows = kept.withColumn(row, inside.cast("bigint"))
    joined = rows.join(firsts, rows[group].eqNullSafe(firsts["_g"]) & (rows[part] == firsts["_p"]))
    out = joined.select(*[rows[c] for c in df.columns], (rows[row] + firsts[first]).alias(row))
    return out, kept.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))


def crc_rest(c: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; a null value counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % divisor


class _Made(dict):
    """Remembers what ``make`` makes of a key: up to ``most`` keys, and those it had when they were last too many."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        self[key] = made
        return made

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


#: what often ends a word; the vocabulary's cutter keeps runs of such marks together
MARKS = ".,;:!?)\"-"


class WordPieces:
    """Ids by a BPE vocabulary that lower-cases, drops white space and marks word ends.

    Words are cut at ASCII white space, which no token crosses, so the ids of a text are
    those of its words in order; words are cut into letter runs, digits and the rest as the
    vocabulary file says, and each distinct piece is merged once. Words that hold ``<|`` go
    through the whole tokenizer, which looks for its special tokens there. Up to about twice
    ``most`` words and pieces are remembered, as little-endian unsigned 32-bit ids.
    """

    def __init__(self, path: str, most: int = 300_000):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            cut = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(cut)
        # the letters that stand for bytes outside printable ASCII, as the byte-level cutter spells them
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = level.pre_tokenize_str("".join(map(chr, range(0x80, 0x800))))[0][0]
        spelled = "".join(map(chr, range(0x80, 0x800))).encode()
        self.spell = {byte: letter for byte, letter in zip(spelled, letters)}
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.merged = self.tokenizer.model.tokenize
        self.words: dict[bytes, bytes] = _Made(self.word, most)
        self.pieces: dict[str, bytes] = _Made(self.piece, most)

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.spell)
        spell = self.bytes_of
        return b"".join([spell[t.id] for t in self.merged(spelled)])

    def word(self, word: bytes) -> bytes:
        if word.isascii():
            text = word.lower().decode("ascii")
        else:
            text = word.decode("utf-8", "replace")
            if not is_normalized("NFC", text):
                text = normalize("NFC", text)
            text = text.lower()
        core = text.rstrip(MARKS)
        if core.isalpha() and "\u03c2" not in core and b"<|" not in word:
            # letters, and perhaps marks behind them, are a piece each
            return self.pieces[core] if len(core) == len(text) else self.pieces[core] + self.pieces[text[len(core) :]]
        if b"<|" in word or "\u03c2" in text or not text.isprintable():
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.cut.findall(text)])

    def encode(self, rows: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        self.words.trim()
        self.pieces.trim()
        get = self.words.__getitem__
        return [b"".join(map(get, row.split())) for row in rows]


_WORD_PIECES: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    """One per worker process and vocabulary, kept between tasks."""
    if path not in _WORD_PIECES:
        _WORD_PIECES[path] = WordPieces(path)
    return _WORD_PIECES[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the default of the path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)
