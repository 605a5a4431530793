"""Token-ID output: documents as zstandard frames of token ids under one shared dictionary, with an offset index.

A shard file holds, in this order: the magic bytes, the sha256 of the dictionary, the frames one after another, the index (five
arrays, one value per document: id, its null mark, offset and length of the frame, number of ids), the number of documents, where the index starts, the
magic bytes again. All numbers are little-endian. A frame is the compressed array of the document's ids (unsigned 32-bit). The
dictionary lies beside the shards under its own hash. A reader fetches the index from the end of the file and then any
document by itself, so a short document costs one short read.

Shards are written under names of their own by each attempt of a task; only those whose rows reach the manifest (a table in the
shared folder) are ever read, so a repeated or lost attempt leaves at most a file that nobody looks at.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.blocks import ids_without_nulls
from stagewise.llm.samples import in_share
from stagewise.llm.tables import shared_path, stored

MAGIC = b"IDSHARD1"
END_ID = 0
#: Texts that the dictionary is trained on, the most characters that each of them may have, and its size in bytes.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 2_000, 20_000, 64 * 1024
LEVEL = 3
#: Rows of one id up to which they may share a shard.
ROWS_OF_AN_ID = 50_000
#: New pieces that go to the library, and new words that go to its model, in one call.
JOINED, WORDS_JOINED = 2_000, 60
#: How byte-level vocabularies write bytes, a blank among them (printable ones stand for themselves, the others follow from 256 on).
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [byte for byte in range(256) if byte not in PRINTED]
BYTE_LETTERS = "".join(chr(byte if byte in PRINTED else 256 + OTHERS.index(byte)) for byte in range(256))
BLANK_MARK = BYTE_LETTERS[32]
#: A blank and then Latin letters (U+00C0 to U+024F but for the two signs among them), digits and ASCII marks other than the apostrophe.
LATIN = re.compile(r" [\x21-\x26\x28-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
LATIN_BYTES = {*range(0xC3, 0xCA), *range(0x80, 0xC0)}
SPACE_AT_CUT = re.compile(r"\s\x00|\x00 \s|\x00[^\S ]")
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
INDEX = (("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8"))


def byte_letters(text: str) -> str:
    """A text as byte-level vocabularies write its bytes."""
    return text.replace(" ", BLANK_MARK) if text.isascii() else codecs.charmap_decode(text.encode(), "strict", BYTE_LETTERS)[0]


def unmixed(token: str) -> bool:
    """Whether a token, if it is made of what ``LATIN`` allows, begins at a blank or holds none, and holds letters, digits or marks only."""
    data = {BYTE_LETTERS.index(letter) for letter in token.lstrip(BLANK_MARK) if letter in BYTE_LETTERS}
    if not all(byte in LATIN_BYTES or 0x20 <= byte <= 0x7E and byte != 0x27 for byte in data):
        return True
    kinds = {"letter" if byte in LATIN_BYTES or chr(byte).isalpha() else "digit" if chr(byte).isdigit() else chr(byte).isspace() for byte in data}
    return len(kinds) <= 1 and True not in kinds


class PieceIds:
    """Ids of the pieces of texts, remembered up to a bound.

    Byte-level tokenizers of this kind cut a text in front of a blank that stands between two non-blanks, and on both sides of a line end
    that does, and encode what lies between the cuts by itself. ``encode`` uses that: the different pieces of a batch are looked up, and new ones
    go through the library many in a call, joined; their ids are cut again where a token begins with a blank. Pieces of Latin letters, digits
    and ASCII marks go to the library's model without its pattern matching, as no token of the vocabulary mixes those kinds (``apart``; else they
    take the other way). Pieces that do not begin with a blank are encoded one by one, and a text with a special token as a whole.

    What is remembered has two generations: at ``most`` pieces the younger becomes the older, and a piece found in the older moves back.
    """

    def __init__(self, path: str, most: int = 450_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = [token.content for token in added.values()]
        cutter = str(self.library.pre_tokenizer)
        self.cuts = cutter.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cutter and self.library.normalizer is None
        self.model = self.library.model
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] == BLANK_MARK and i not in added]] = True
        self.apart = all(unmixed(token) for token, i in vocabulary.items() if i not in added)
        # Plain dictionaries of texts and bytes, which the garbage collector leaves alone.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one_by_one(self, pieces: list[str]) -> None:
        """Remember pieces by the library, each for itself."""
        for piece, found in zip(pieces, self.library.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = array("I", found.ids).tobytes()

    def joined(self, pieces: list[str]) -> None:
        """Remember pieces that begin with a blank and hold no other white space next to one, many in a call."""
        rest: list[str] = []
        if self.apart:
            plain, others = list(filter(str.isascii, pieces)), list(filterfalse(str.isascii, pieces))
            for start in range(0, len(plain), WORDS_JOINED):
                some = plain[start : start + WORDS_JOINED]
                text = "".join(some)
                if "'" in text or not text.isprintable():
                    rest += [piece for piece in some if "'" in piece or not piece.isprintable()]
                    some = [piece for piece in some if "'" not in piece and piece.isprintable()]
                self.cut_again(some, self.model_ids)
            latin = list(filter(LATIN.fullmatch, others))
            for start in range(0, len(latin), WORDS_JOINED):
                self.cut_again(latin[start : start + WORDS_JOINED], self.model_ids)
            rest += filterfalse(LATIN.fullmatch, others)
        else:
            rest = pieces
        for start in range(0, len(rest), JOINED):
            self.cut_again(rest[start : start + JOINED], lambda text: self.library.encode(text, add_special_tokens=False).ids)

    def model_ids(self, text: str) -> list[int]:
        """Ids by the library's model alone."""
        return [token.id for token in self.model.tokenize(byte_letters(text))]

    def cut_again(self, pieces: list[str], ids_of: Callable[[str], list[int]]) -> None:
        """Remember pieces by the ids of all of them joined."""
        ids = np.array(ids_of("".join(pieces)), "<u4")
        at = (np.flatnonzero(self.opens[ids]) * 4).tolist() if len(ids) else []
        if len(at) != len(pieces):
            self.one_by_one(pieces)
            return
        data = ids.tobytes()
        self.known.update(zip(pieces, map(data.__getitem__, map(slice, at, [*at[1:], len(data)])), strict=True))

    def learn(self, new: set[str]) -> None:
        """Remember pieces that are not remembered yet; those with white space at a cut are left out."""
        if self.older:
            back = list(filter(self.older.__contains__, new))
            self.known.update(zip(back, map(self.older.__getitem__, back), strict=True))
            new = set(filterfalse(self.older.__contains__, new))
        letters = "".join(new).replace(" ", "")
        if " " in new or letters.split(None, 1) != [letters]:
            new = {piece for piece in new if not SPACE_AT_CUT.search(f"\0{piece}\0")}
        self.joined([piece for piece in new if piece[0] == " "])
        self.one_by_one([piece for piece in new if piece[0] != " "])

    def found(self, pieces: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Ids of pieces, and the places of those that are not remembered."""
        ids, gaps, at = list(map(self.known.get, pieces)), [], -1
        try:
            while True:
                at = ids.index(None, at + 1)
                gaps.append(at)
        except ValueError:
            return ids, gaps

    def looked_up(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts that are neither empty nor hold null characters or empty lines, with the end id; none where a piece is left out.

        Arrow cuts all texts at once and counts equal pieces as one, so that only the different ones become Python objects.
        """
        cut = pa.array([text.replace(" ", "\0 ").replace("\n", "\0\n\0") for text in texts], pa.large_string())
        lists = pc.split_pattern(cut, "\0")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, gaps = self.found(pieces)
        if gaps:
            self.learn({pieces[at] for at in gaps})
            for at in gaps:
                ids[at] = self.known.get(pieces[at])
        laid = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = lists.offsets.to_numpy()[1:]
        gone = np.zeros(len(laid) + 1, np.int64)
        if laid.null_count:
            np.cumsum(laid.is_null().to_numpy(zero_copy_only=False), out=gone[1:])
        offsets, data = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1), memoryview(laid.buffers()[2] or b"")
        places, lost = offsets[ends].tolist(), np.diff(gone[ends], prepend=0).tolist()
        end = np.array([END_ID], "<u4").tobytes()
        return [None if n else b"".join((data[x:y], end)) for x, y, n in zip([0, *places], places, lost, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, with the end id. Null texts are empty ones."""
        end = np.array([END_ID], "<u4").tobytes()
        if not self.cuts or any(" " in s for s in self.special):
            return [self.whole(text or "") + end for text in texts]
        if len(self.known) >= self.most:
            self.older, self.known = self.known, {}
        self.known |= {"": b"", "\n": self.whole("\n")}
        out: list[bytes | None] = [None if text else end for text in texts]
        plain: list[int] = []
        for i, text in enumerate(texts):
            if text and any(s in text for s in self.special):
                out[i] = self.whole(text) + end
            elif text and "\0" not in text and "\n\n" not in text:
                plain.append(i)
        if plain:
            for i, found in zip(plain, self.looked_up([texts[i] for i in plain]), strict=True):
                out[i] = found
        # The rest is cut where it is safe. Pieces that ``learn`` leaves out, as those of the texts above, are encoded one by one.
        seen = set(plain)
        rest = [i for i, found in enumerate(out) if found is None]
        cuts = {i: SAFE_CUT.split(texts[i]) for i in rest}
        self.learn({piece for i in rest if i not in seen for piece in cuts[i] if piece not in self.known})
        self.one_by_one(list({piece for i in rest for piece in cuts[i] if piece not in self.known}))
        for i in rest:
            out[i] = b"".join(map(self.known.__getitem__, cuts[i])) + end
        return out


_pieces: dict[str, PieceIds] = {}


def pieces_of(path: str) -> PieceIds:
    """The encoder of a tokenizer file, one for each Python worker."""
    if path not in _pieces:
        _pieces[path] = PieceIds(path)
    return _pieces[path]


def file_system(url: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder named by URL or local path."""
    return pyarrow.fs.FileSystem.from_uri(url if "://" in url or not url.startswith("file:") else "file://" + url[5:])


def batches(texts: list[str], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list whose texts hold so many characters together, or a single longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most_chars:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)


def train_dictionary(docs: DataFrame, tokenizer: str, sample: int = SAMPLE_TEXTS) -> bytes:
    """Dictionary from the ids of ``sample`` whole texts of up to ``SAMPLE_CHARS`` characters: those whose hash is smallest. The bounds make it fit the driver.

    Returns no bytes, for plain frames, where the texts are too few or too short to train on.
    """
    some = docs.filter(in_share(F.col("doc_id"), sample, docs.count())).filter(F.length("text").between(1, SAMPLE_CHARS))
    some = some.select(F.xxhash64("text").alias("h"), "text")
    texts = [row.text for row in some.orderBy("h", "text").limit(sample).collect()]
    ids = pieces_of(tokenizer).encode(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, dictionary: bytes) -> DataFrame:
    """Write shards in ascending order of ``doc_id`` and return the manifest.

    One row per shard: ``shard`` (its place in the order), ``path``, ``n_docs``, ``n_tokens``. Null texts count as empty ones.
    Null ids come first; rows with equal ids follow each other by the hash of their text, so that an id with very many texts is spread over
    shards too, and repeated rows are each written. An empty table gives an empty manifest. Other columns are not looked at. How many
    shards there are follows the number of shuffle partitions and AQE.
    """
    spark = docs.sparkSession
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    name = hashlib.sha256(dictionary).hexdigest()
    with system.open_output_stream(f"{root}/{name}.dictionary") as sink:
        sink.write(dictionary)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        encoder, (files, top) = pieces_of(tokenizer), file_system(folder)
        path, sink, at, parts, shard = f"{top}/{uuid.uuid4().hex}.ids", None, 0, [], 0
        for frame in frames:
            texts, keys, nulls = frame["text"].tolist(), frame["doc_id"].to_numpy("<i8"), frame["no_id"].to_numpy(np.uint8)
            for a, b in batches(texts):
                if sink is None:
                    shard, sink = int(frame["shard"].iloc[0]), files.open_output_stream(path)
                    sink.write(MAGIC + hashlib.sha256(dictionary).digest())
                    at = len(MAGIC) + 32
                ids = encoder.encode(texts[a:b])
                pressed = [press.compress(x) for x in ids]
                sizes = np.array([len(x) for x in pressed], "<u8")
                sink.write(b"".join(pressed))
                starts = at + np.cumsum(sizes) - sizes
                parts.append((keys[a:b], nulls[a:b], starts.astype("<u8"), sizes, np.array([len(x) // 4 for x in ids], "<u8")))
                at += int(sizes.sum())
        if sink is None:
            return
        index = [np.concatenate(column) for column in zip(*parts, strict=True)]
        sink.write(b"".join(x.astype(kind).tobytes() for x, (_, kind) in zip(index, INDEX, strict=True)))
        sink.write(np.array([len(index[0]), at], "<u8").tobytes() + MAGIC)
        sink.close()
        yield pd.DataFrame({"shard": [shard], "path": [path], "n_docs": [len(index[0])], "n_tokens": [int(index[4].sum())]})

    rows = ids_without_nulls(docs)
    many = rows.groupBy("no_id", "doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > ROWS_OF_AN_ID)
    order = [F.desc("no_id"), F.col("doc_id"), F.col("tie")]
    # Borders by text cost a pass over all texts, so they are only drawn where an id needs them; the order is the same.
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*(order[:2] if many.isEmpty() else order))
    rows = dealt.sortWithinPartitions(*order, "text")
    rows = rows.select("no_id", "doc_id", "text", F.spark_partition_id().alias("shard"))
    done = rows.mapInPandas(write, "shard long, path string, n_docs long, n_tokens long")
    return stored(done, "token-manifest")


def read_index(source: pyarrow.NativeFile) -> dict[str, np.ndarray]:
    """Index of a shard file."""
    size = source.size()
    n, at = np.frombuffer(source.read_at(16, size - 24), "<u8").tolist()
    raw, out, done = source.read_at(size - 24 - at, at), {}, 0
    for name, kind in INDEX:
        out[name] = np.frombuffer(raw, kind, n, done)
        done += out[name].nbytes
    return out


def read_document(folder: str, path: str, place: int) -> np.ndarray:
    """Ids of the document at one place of a shard, by its own frame alone."""
    files, top = file_system(folder)
    with files.open_input_file(path) as source:
        index = read_index(source)
        frame = source.read_at(int(index["length"][place]), int(index["offset"][place]))
        return np.frombuffer(_opener(files, top, source.read_at(32, len(MAGIC)).hex()).decompress(frame), "<u4")


def _opener(files: pyarrow.fs.FileSystem, top: str, name: str) -> zstandard.ZstdDecompressor:
    """Decompressor for the dictionary of this hash."""
    with files.open_input_stream(f"{top}/{name}.dictionary") as source:
        data = source.read()
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError(f"dictionary {name} is damaged")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)


def read_token_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Documents of the shards in a manifest: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``
    (binary, little-endian unsigned 32-bit), ``shard``, ``place``.

    With ``digest``, ``ids_crc32`` (their unsigned crc32) stands in place of the ids, which then stay in the tasks that read them. The running total goes over the manifest, which has one short row per shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    column, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = file_system(folder)
        openers: dict[str, zstandard.ZstdDecompressor] = {}
        for frame in frames:
            for shard, path, start in zip(frame["shard"], frame["path"], frame["start"], strict=True):
                with files.open_input_file(path) as source:
                    name = source.read_at(32, len(MAGIC)).hex()
                    if source.read_at(len(MAGIC), 0) != MAGIC:
                        raise ValueError(f"{path} is no shard")
                    opener = openers.setdefault(name, _opener(files, top, name))
                    index = read_index(source)
                    starts = start + np.cumsum(index["n_tokens"]) - index["n_tokens"]
                    for a, b in _spans(index["length"]):
                        base = int(index["offset"][a])
                        raw = source.read_at(int(index["offset"][b - 1] + index["length"][b - 1]) - base, base)
                        at = (index["offset"][a:b] - base).tolist()
                        ids = [opener.decompress(raw[x : x + n]) for x, n in zip(at, index["length"][a:b].tolist(), strict=True)]
                        keys = pd.array(index["doc_id"][a:b], dtype="Int64")
                        keys[index["is_null"][a:b] > 0] = pd.NA
                        yield pd.DataFrame(
                            {
                                "doc_id": keys,
                                "start": starts[a:b].astype("int64"),
                                "n_tokens": index["n_tokens"][a:b].astype("int64"),
                                column: [zlib.crc32(x) for x in ids] if digest else ids,
                                "shard": shard,
                                "place": np.arange(a, b),
                            }
                        )

    n = max(1, manifest.count())
    dealt = shards.repartition(n, "shard")
    return dealt.mapInPandas(read, f"doc_id long, start long, n_tokens long, {column} {kind}, shard long, place long")


def _spans(lengths: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents to read at once."""
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, b
        a = b


def token_ids(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Encode, write and read back all documents; the files stay in ``folder`` (a new shared one if none is given).

    Returns ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (unsigned), ``shard``, ``place``. See ``write_token_files`` for nulls, ties and
    empty tables.
    """
    folder = folder or shared_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, train_dictionary(docs, tokenizer))
    return read_token_files(manifest, folder, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "place")
