"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one connection a Python worker.

A group of texts is cut into pattern matches; a match that is a token by itself is that token. The others become rows of
(word, position, token), starting from single bytes, and a recursive query joins neighbours to the merge table and contracts
each word's leftmost pair of minimum rank until no pair merges. Decoding joins ids to the vocabulary and concatenates in order.

In a word of over ``SHORT`` bytes a step contracts all pairs of least rank within twice the longest possible token on either
side: nothing nearer can still bring forth a lower rank that touches them, and nothing farther reaches them within one token.
Of such pairs of one rank near each other all go at once unless one of them could bring forth a lower rank itself; then only
the leftmost goes. So the tokens are those of contracting one pair at a time, in far fewer steps.

A word of over ``PIECE`` bytes is contracted in pieces, whose seams are held against what the tokens on both sides are by themselves.

Words met lately are kept in two bounded generations. Texts run through in groups of about ``GROUP`` characters, whatever
the size of Arrow batches, so memory doesn't grow with the input. Defined cases: a null or empty text has no tokens and
decodes to nothing; of pairs tied in rank the leftmost goes first; repeated rows each get theirs; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release

#: Characters of a group of texts, words of a cache generation, recursive steps of a round for long words, bytes of a short word, words a query.
GROUP, CACHED, ROUND, SHORT, WORDS = 1_000_000, 300_000, 8, 48, 20_000
#: Bytes of long words a query, or one longer word; bytes of a word cut into pieces and tokens it gives back at a cut; words of a long text and ids taken at once.
LONG, PIECE, BACK, SLICE = 50_000, 200_000, 64, 200_000
#: Fixed value: how texts are cut before merging; public_tokenizers.PATTERN by default.
DEFAULT = "byte_bpe_multi_50k.tiktoken"

#: Long words. A key holds word and position, so that no join can meet on words alone; ``reach`` is a power of two, so no block
#: of that many bytes has two words. ``hits`` are the pairs of least rank in their block and in both blocks beside it; ``parity``
#: tells every other one of overlapping hits, null where their first is no hit yet; a hit is loud if its token could at once merge at a lower rank.
_CONTRACT = """
WITH RECURSIVE state(k, tok, nk, nxt, depth) AS (
  SELECT w::BIGINT * 4294967296 + pos, tok, w::BIGINT * 4294967296 + npos, nxt, 0::INTEGER FROM fresh
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT s.k, s.nk, m.id, s.k // {reach} AS block, row_number() OVER o AS i,
       CASE WHEN lag(s.nk) OVER o = s.k THEN lag(s.tok) OVER o END AS before, CASE WHEN lag(s.nk) OVER o = s.k THEN lag(m.id) OVER o END AS earlier,
       CASE WHEN lead(s.k) OVER o = s.nk THEN lead(s.nxt) OVER o END AS after
     FROM state s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt WHERE s.depth < {depth} WINDOW o AS (ORDER BY s.k)),
   low AS MATERIALIZED (SELECT block, min(id) AS least FROM pairs WHERE id IS NOT NULL GROUP BY block),
   clear AS MATERIALIZED (
     SELECT o.*, coalesce(u.least > o.least, true) AS first FROM low o LEFT JOIN low u ON u.block = o.block - 1 LEFT JOIN low v ON v.block = o.block + 1
     WHERE coalesce(u.least >= o.least, true) AND coalesce(v.least >= o.least, true)),
   hits AS MATERIALIZED (
     SELECT p.*, c.first, p.i - row_number() OVER (ORDER BY p.k) AS run,
       coalesce(x.id < p.id, false) OR coalesce(y.id < p.id, false) OR coalesce(z.id < p.id, false) AS loud
     FROM pairs p JOIN clear c ON c.block = p.block AND c.least = p.id
     LEFT JOIN merges x ON x.l = p.before AND x.r = p.id LEFT JOIN merges y ON y.l = p.id AND y.r = p.after LEFT JOIN merges z ON z.l = p.id AND z.r = p.id),
   chained AS MATERIALIZED (SELECT *, (i - max(CASE WHEN earlier IS DISTINCT FROM id THEN i END) OVER (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING)) % 2 AS parity FROM hits),
   judged AS MATERIALIZED (SELECT block, bool_or(loud) AS loud, min(k) AS leftmost FROM hits GROUP BY block),
   spot AS MATERIALIZED (
     SELECT h.k AS p, h.id AS made, h.nk AS gone
     FROM chained h JOIN judged j ON j.block = h.block LEFT JOIN judged u ON u.block = h.block - 1 LEFT JOIN judged v ON v.block = h.block + 1
     WHERE CASE WHEN j.loud OR coalesce(u.loud, false) OR coalesce(v.loud, false) THEN h.first AND h.k = j.leftmost ELSE h.parity = 0 END),
   change AS MATERIALIZED (SELECT spot.*, r.nk AS nk2, r.nxt AS nxt2 FROM spot JOIN state r ON r.k = spot.gone)
   SELECT s.k, coalesce(a.made, s.tok), coalesce(a.nk2, s.nk), coalesce(n.made, CASE WHEN a.p IS NULL THEN f.made ELSE a.nxt2 END, s.nxt), s.depth + 1
   FROM state s LEFT JOIN change a ON a.p = s.k LEFT JOIN change f ON f.p = s.nk LEFT JOIN change n ON n.p = a.nk2 LEFT JOIN change g ON g.gone = s.k
   WHERE g.gone IS NULL AND s.k // 4294967296 IN (SELECT p // 4294967296 FROM spot))
)
SELECT (k // 4294967296)::INTEGER AS w, (k % 4294967296)::INTEGER AS pos, tok, (nk % 4294967296)::INTEGER AS npos, nxt, depth
FROM (SELECT *, max(depth) OVER (PARTITION BY k // 4294967296) AS deepest FROM state) WHERE depth = deepest ORDER BY k
"""

#: Short words, one pair a step: each row knows its right neighbour, so a step needs hash joins only, no sort.
_SHORT = """
WITH RECURSIVE state(w, pos, tok, npos, nxt, depth) AS (
  SELECT w, pos, tok, npos, nxt, 0::INTEGER FROM fresh
  UNION ALL
  (WITH best AS (
     SELECT w, min(m.id::BIGINT * 65536 + pos) AS b FROM state s JOIN merges m ON m.l = s.tok AND m.r = s.nxt GROUP BY w),
   spot AS (
     SELECT b.w, (b.b % 65536)::INTEGER AS p, (b.b // 65536)::INTEGER AS made, s.npos AS gone
     FROM best b JOIN state s ON s.w = b.w AND s.pos = b.b % 65536),
   change AS (
     SELECT spot.*, r.npos AS npos2, r.nxt AS nxt2 FROM spot JOIN state r ON r.w = spot.w AND r.pos = spot.gone)
   SELECT s.w, s.pos, CASE WHEN s.pos = p THEN made ELSE s.tok END, CASE WHEN s.pos = p THEN npos2 ELSE s.npos END,
     CASE WHEN s.pos = p THEN nxt2 WHEN s.npos = p THEN made ELSE s.nxt END, s.depth + 1
   FROM state s JOIN change c ON c.w = s.w WHERE s.pos <> gone)
)
SELECT s.w, s.tok FROM state s JOIN (SELECT w, max(depth) AS depth FROM state GROUP BY w) USING (w, depth) ORDER BY s.w, s.pos
"""


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


class Bpe:
    """Vocabulary, merge table and word cache of one worker."""

    _own: dict[tuple[str, str], "Bpe"] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        left, right, made = [], [], []
        for i, token in enumerate(self.tokens):
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        l, r, m = (np.array(x, np.int32) for x in (left, right, made))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})  # bounded groups fit, nothing spills
        self.db.register("given", pa.table({"l": l, "r": r, "id": m}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.db.register("given", pa.table({"id": np.arange(len(self.tokens), dtype=np.int32), "piece": [t.decode("latin-1") for t in self.tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.bytes = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Bpe":
        if (path, pattern) not in cls._own:
            cls._own[path, pattern] = cls(path, pattern)
        return cls._own[path, pattern]

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian unsigned 32-bit) of each word."""
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        for i in range(0, len(short), WORDS):
            part = short[i : i + WORDS]
            for k, ids in zip(part, self._contract_short([words[k] for k in part]), strict=True):
                out[k] = ids
        part, size = [], 0
        for k in [*(k for k, w in enumerate(words) if len(w) > SHORT), None]:
            if part and (k is None or size + len(words[k]) > LONG):
                found = [self._contract_pieces(words[part[0]])] if size > PIECE else self._contract_long([words[i] for i in part])
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
                part, size = [], 0
            if k is not None:
                part.append(k)
                size += len(words[k])
        return out

    def _register(self, words: list[bytes]) -> None:
        """Token-position rows of ``words``, each with its right neighbour, as ``given``."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        tokens = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        following = np.append(tokens[1:], np.int32(-1)).astype(np.int32)
        following[np.cumsum(lengths) - 1] = -1
        self.db.register("given", pa.table({"w": owner, "pos": place, "tok": tokens, "npos": place + np.int32(1), "nxt": following}))

    def _contract_short(self, words: list[bytes]) -> list[bytes]:
        self._register(words)
        self.db.execute("CREATE OR REPLACE TEMP TABLE fresh AS SELECT * FROM given")
        self.db.unregister("given")
        found = self.db.execute(_SHORT).fetchnumpy()
        ends = np.cumsum(np.bincount(found["w"], minlength=len(words))) * 4
        raw = np.asarray(found["tok"]).astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        """By rounds of at most ``ROUND`` recursive steps; words at their fixpoint leave."""
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        letters = set().union(*words)
        reach = 1 << max(len(t) for t in self.tokens if letters.issuperset(t)).bit_length() + 1  # over twice the longest token
        self._register(words)
        while True:
            self.db.execute("CREATE OR REPLACE TEMP TABLE fresh AS SELECT * FROM given")
            self.db.unregister("given")
            found = {k: np.asarray(v) for k, v in self.db.execute(_CONTRACT.format(depth=ROUND, reach=reach)).fetchnumpy().items()}
            ended = found["depth"] < ROUND
            w = found["w"][ended]
            for k, ids in zip(*(np.split(x, np.flatnonzero(np.diff(w)) + 1) for x in (w, found["tok"][ended])), strict=True):
                if len(k):
                    out[k[0]] = ids.astype("<u4").tobytes()
            if ended.all():
                return out
            self.db.register("given", pa.table({k: found[k][~ended] for k in ("w", "pos", "tok", "npos", "nxt")}))

    def _stand(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay as they are."""
        return self.contract([self.tokens[left] + self.tokens[right]])[0] == np.array([left, right], "<u4").tobytes()

    def _contract_pieces(self, word: bytes) -> bytes:
        """A very long word, piece by piece, so that no query holds more than about ``PIECE`` of its bytes.

        Tokens are a word's if every two neighbours stand side by side: the first contraction over a boundary would also come first among the
        two alone. A piece gives back its last tokens, as the next bytes may change them; where the seam to the next piece doesn't
        stand, more is given back, at last the whole word.
        """
        ids, start, back, more = np.empty(0, "<u4"), 0, BACK, 0
        while True:
            end = start + PIECE + more
            found = np.frombuffer(self._contract_long([word[start:end]])[0], "<u4")
            if len(ids) and not self._stand(int(ids[-1]), int(found[0])):
                given = sum(len(self.tokens[i]) for i in ids[-back:].tolist())
                ids, start, more, back = ids[:-back], start - given, more + given, back * 4
                continue
            if end >= len(word):
                return np.concatenate([ids, found]).tobytes()
            kept = found[:-BACK]
            if not len(kept):  # a piece of few tokens: a longer one
                more += PIECE
                continue
            ids, start, back, more = np.concatenate([ids, kept]), start + sum(len(self.tokens[i]) for i in kept.tolist()), BACK, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Words of a long text are taken in slices."""
        if sum(map(len, texts)) <= 2 * GROUP:
            return self._encode_words([self.pattern.findall(t) for t in texts])
        out = []
        for text in texts:
            parts, words = [], []
            for match in self.pattern.finditer(text):
                words.append(match.group())
                if len(words) == SLICE:
                    parts += self._encode_words([words])
                    words = []
            out.append(b"".join(parts + self._encode_words([words])))
        return out

    def _encode_words(self, cut: list[list[str]]) -> list[bytes]:
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        held: dict[str, bytes] = {}
        fresh = []
        for w in set().union(*cut):
            ids = self.young.get(w) or self.old.get(w)
            if ids is None:
                fresh.append(w)
            else:
                held[w] = ids
        raw = [w.encode() for w in fresh]
        own = [self.rank.get(w) for w in raw]
        held.update((w, i.to_bytes(4, "little")) for w, i in zip(fresh, own, strict=True) if i is not None)
        rest = [k for k, i in enumerate(own) if i is None]
        if rest:
            held.update(zip((fresh[k] for k in rest), self.contract([raw[k] for k in rest]), strict=True))
        self.young.update((w, ids) for w, ids in held.items() if len(w) <= LONG)  # very long words hardly come twice
        get = held.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence, by an ordered aggregation over slices of ids; a byte travels as the code point of its value.

        A token's bytes don't depend on its neighbours, so a sequence may be cut between any two ids.
        """
        owners = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        whole, parts = np.frombuffer(b"".join(ids), "<u4"), [[] for _ in ids]
        for i in range(0, len(whole), SLICE):
            flat = whole[i : i + SLICE].astype(np.int32)
            self.db.register("given", pa.table({"w": owners[i : i + SLICE], "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
            for w, text in self.db.execute("SELECT w, array_to_string(list(v.piece ORDER BY pos), '') FROM given g JOIN vocabulary v ON v.id = g.id GROUP BY w").fetchall():
                parts[w].append(text.encode("latin-1"))
            self.db.unregister("given")
        return [b"".join(p) for p in parts]


def _groups(texts: list[str]):
    """Index ranges of about ``GROUP`` characters, or of one longer text."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > GROUP:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(DEFAULT), pattern or public_tokenizers.PATTERN


def encode_column(column: str = "text", path: str | None = None, pattern: str | None = None):
    """Token ids of a text column."""
    at = _settings(path, pattern)

    def run(texts: pd.Series) -> pd.Series:
        bpe, given, out = Bpe.of(*at), [t or "" for t in texts], []
        for a, b in _groups(given):
            out += [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(given[a:b])]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")(column)


def decode_column(column: str = "ids", path: str | None = None, pattern: str | None = None):
    """Bytes of a column of token ids."""
    at = _settings(path, pattern)

    def run(ids: pd.Series) -> pd.Series:
        bpe, given = Bpe.of(*at), [np.asarray(x if x is not None else [], "<u4").tobytes() for x in ids]
        return pd.Series([y for k in range(0, len(given), 500) for y in bpe.decode(given[k : k + 500])], dtype=object)

    return F.pandas_udf(run, "binary")(column)


def round_trip(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: encodes every text, then decodes the ids."""
    at = _settings(path, pattern)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def digests(ids: list, texts: list[str]) -> pd.DataFrame:
        bpe = Bpe.of(*at)
        codes = bpe.encode(texts)
        out = pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_tokens": [len(x) // 4 for x in codes], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in codes]})
        return out.assign(decoded_sha256=[hashlib.sha256(x).hexdigest() for x in bpe.decode(codes)])

    def run(batches):
        """Groups of texts over batches: the size of a query doesn't hang on the size of a batch."""
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                t = t or ""
                if texts and held + len(t) > GROUP:
                    yield digests(ids, texts)
                    ids, texts, held = [], [], 0
                    release()
                ids.append(None if pd.isna(i) else i), texts.append(t)
                held += len(t)
        if texts:
            yield digests(ids, texts)
        ids, texts = [], []
        release()

    rows = documents.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    with bounded_batches(documents.sparkSession):
        return materialize(rows.withColumn("doc_id", F.col("doc_id").cast(kind)), "tokens")
