"""Pages made of repeated keywords, link lists or product tags instead of sentences.

Each line of a page, cut after its sentences, becomes one symbol by its
outward form; where more than half of a line's words are the few words that dominate the whole
page, it is a repetition, sentence or not. A hidden Markov model with the states prose, link list, tag list and menu
labels the lines; its tables start from the priors below and are re-estimated from the counts of
Viterbi paths over the whole corpus, where the priors weigh as much as the data. A page is
flagged if more than half of its words stand in lines of the other three states. Logs and code
are emitted by the prose state.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.sources.scratch import Scratch
from arborine.sources.tables import for_all_cores

STATES = ("prose", "links", "tags", "menu")
#: empty, code, log, sentence, sentence with link, bare links, anchored link, phrase list, repetition, product or count, menu, heading, short, other
SYMBOLS = "eclsxuktrpmhbo"
#: Chance of each symbol in each state, in hundredths, before any counting.
EMISSION = {
    "prose": dict(e=22, c=15, l=5, s=38, x=5, h=5, b=3, o=4, k=1, u=1, p=0.5, t=0.3, r=0.1, m=0.1),
    "links": dict(e=10, u=40, k=40, b=4, m=2, h=1, o=1, p=1, s=0.3, x=0.2, t=0.3, r=0.1, c=0.05, l=0.05),
    "tags": dict(e=8, t=28, r=24, p=24, b=10, m=1, o=2, k=1, u=1, h=0.5, s=0.3, x=0.1, c=0.05, l=0.05),
    "menu": dict(e=8, m=50, b=25, k=6, u=2, p=2, t=2, r=1, h=3, o=0.5, s=0.3, x=0.1, c=0.05, l=0.05),
}
STAY = {"prose": 0.94, "links": 0.88, "tags": 0.88, "menu": 0.6}
START = {"prose": 0.7, "links": 0.1, "tags": 0.1, "menu": 0.1}

#: Frequent function words (fixed values): a line that has none of them is no sentence.
FUNCTION_WORDS = frozenset(
    """a an and any are as at be been before but by can cannot could do does for from had has have he her his how i if in into is it its
    me more my no nor not nobody of on one once or our she so than that the their them then there these they this those to too until was we were what when
    where which while who whatever why will with would you your please every each all
    der die das den dem des ein eine einen einem und oder nicht mehr ist sind wird werden war für von vom zum zur im in mit auf nach wenn es sich auch als
    el la los las un una unos de del que en y o no se es son con por para cada cuando si su al como lo más sin
    le les l d une du des et ou que qui dans pour par sur est sont ne pas plus si au aux ce cette il elle on avec
    o os as um uma do da dos das e em não com por para se que il lo gli di e che in un una per con non""".split()
)
_URL = re.compile(r"https?://[^\s)\]>]+|www\.[^\s)\]>]+")
_EMPTY = re.compile(r"[(\[<]\s*[)\]>]")
_ANCHOR = re.compile(r"\[([^\[\]\n]*)\]\([^()\s]+\)|<a\s[^<>]*>([^<]*)</a>")
_LOG = re.compile(r"^\W{0,3}(?:\d{4}-\d\d-\d\d|\d\d[:/]\d\d[:/]\d\d|\[?\d{10,13}\]?)|^\s*(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\b|^\s*at \S+\(|^Traceback |^\s+File \"")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CODE = re.compile(r"^(?:\t| {4,})\S|[;{}]\s*$|^\s*(?://|/\*|\*/|#include|import |package |from \S+ import|def |class |return\b|<[/!?a-zA-Z])")
_MENU = re.compile(r"[»›→]|(?:\S+ ?[|>] ?){2,}")
_SEPARATOR = re.compile(r"[,;|·•/–—]| - ")
_COUNT = re.compile(r"\(\d[\d.,]*\)|[$€£¥]\s?\d|\b[A-Z]{2,5}-?\d{3,}\b|\b\d+\.\d+\b|\b(?:SKU|USD|EUR)\b|\d\s?[€%]")
_HEADING = re.compile(r"#{1,6}\s")
_HASHTAG = re.compile(r"(?:^|\s)#\w")
#: Signs of scripts that put no spaces between words, or few.
_CJK = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_ENDS = (".", "!", "?", "。", "！", "？", "…", ":", ".)", ".\"", "»", "؟", "।")
_SENTENCES = re.compile(r"(?<=[.!?。])\s+|(?<=[。！？])")
#: Lines of these symbols become repetitions where words that dominate the page fill them.
_PLAIN = frozenset("sxboh")
#: The words that dominate a page: at most so many, each with at least this share of the page's words and so many places.
DOMINANT, DOMINANT_SHARE, DOMINANT_TIMES = 4, 0.05, 5


def _bare(s: str) -> tuple[str, int, int]:
    """A line without its link targets, and its numbers of anchors and of bare links."""
    bare = _ANCHOR.sub(lambda m: f" {m.group(1) or m.group(2) or ''} ", s)
    anchors = len(_ANCHOR.findall(s))
    bare, urls = _URL.subn(" ", bare)
    return (_EMPTY.sub(" ", bare) if urls else bare), anchors, urls


def line_symbol(line: str) -> tuple[str, int]:
    """The symbol of one line and its number of words; links count as one word each, CJK text as a word per two signs."""
    s = line.strip()
    if not s:
        return "e", 0
    bare, anchors, urls = _bare(s)
    tokens = _WORD.findall(bare)
    cjk = len(_CJK.findall(bare))
    n = len(tokens) if not cjk else max(len(tokens), cjk // 2)
    links, words = anchors + urls, n + urls + (anchors if not n else 0)
    if _LOG.search(s):
        return "l", words
    low = [t.lower() for t in tokens]
    function = sum(t in FUNCTION_WORDS for t in low)
    tail = bare.rstrip(" \t*_)\"'”")
    if not function and len(tokens) >= 4 and tail.endswith(_ENDS) and not _COUNT.search(s):
        # perhaps another language: small words are short in all that have spaces
        function = sum(len(t) <= 3 and t == t.lower() and not t.isdigit() for t in tokens)
    if cjk > 6:
        sentence = tail.endswith(("。", "！", "？", "．")) or bool(re.search(r"[ぁ-ん]{2}", bare) and "。" in bare)
    else:
        sentence = function >= 1 and function * 9 >= len(tokens) and len(tokens) >= 3 and (tail.endswith(_ENDS) or function * 4 >= len(tokens) >= 8)
    if sentence and links * 3 <= n:
        return ("x" if links else "s"), words
    if _CODE.search(line) and not links and function * 9 < max(len(tokens), 1) + 9 and len(_SEPARATOR.findall(s)) < 8:
        return "c", words
    if _MENU.search(bare) and n <= 40:
        return "m", words
    if links:
        if urls and not anchors and urls * 2 >= words:
            return "u", words
        return ("k" if n <= 12 * links else "o"), words
    if _HEADING.match(s) or set(s) <= set("=-*_~ "):
        return ("h" if n <= 12 else "o"), words
    if (marked := len(_HASHTAG.findall(bare))) >= 3 and marked * 2 >= n // 2:
        return "t", words
    parts = [p for p in _SEPARATOR.split(bare) if p.strip()]
    if len(parts) >= 5 and n <= 5 * len(parts):
        return "t", words
    if n >= 12 and (len(set(low)) * 2 <= len(low) or function * 12 < len(tokens)):
        return "r", words
    if n <= 12 and _COUNT.search(s):
        return "p", words
    return ("b" if n <= 8 else "o"), words


def _repetitions(symbols: list[str], lines: list[str], parts: list[int]) -> list[str]:
    """``symbols`` with "r" for plain parts of lines of which the page's dominant words are more than half; code and logs have no part in it.

    ``parts`` has the line of each part. Words of scripts without spaces are not told apart and dominate nothing.
    """
    said = [[] if k in "ecl" else [t.lower() for t in _WORD.findall(_bare(line)[0])] for k, line in zip(symbols, lines)]
    total = sum(map(len, said))
    counts = Counter(w for words in said for w in words if w not in FUNCTION_WORDS and not w.isdigit() and not _CJK.search(w))
    least = max(DOMINANT_TIMES, DOMINANT_SHARE * total)
    dominant = {w for w, n in counts.most_common(DOMINANT) if n >= least}
    if not dominant:
        return symbols
    balance: Counter = Counter()
    for at, words in zip(parts, said):
        balance[at] += 2 * sum(w in dominant for w in words) - len(words)
    return ["r" if k in _PLAIN and balance[at] > 0 else k for k, at in zip(symbols, parts)]


def page_symbols(text: str) -> tuple[str, list[int]]:
    """Symbols and word numbers of all lines of a page; lines within code fences are code."""
    symbols, words, lines, parts, fenced = [], [], [], [], False
    for at, line in enumerate(text.splitlines()):
        if line.lstrip()[:3] in ("```", "~~~"):
            fenced = not fenced
            symbols.append("c")
            words.append(0)
            lines.append("")
        elif fenced:
            symbols.append("c")
            words.append(len(line.split()))
            lines.append("")
        else:
            for part in _SENTENCES.split(line):
                k, n = line_symbol(part)
                symbols.append(k)
                words.append(n)
                lines.append(part)
        parts += [at] * (len(lines) - len(parts))
    return "".join(_repetitions(symbols, lines, parts)), words


def tables(counts: dict[str, float] | None = None, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log start, transition and emission chances: the priors, with ``counts`` of a corpus mixed in at ``weight``.

    ``counts`` has keys ``"e" + state + symbol`` and ``"t" + state + state`` by index.
    """
    n = len(STATES)
    start = np.array([START[s] for s in STATES])
    move = np.array([[STAY[a] if a == b else (1 - STAY[a]) / (n - 1) for b in STATES] for a in STATES])
    emit = np.array([[EMISSION[s].get(k, 0.05) for k in SYMBOLS] for s in STATES])
    emit /= emit.sum(1, keepdims=True)
    if counts:
        for kind, prior in (("t", move), ("e", emit)):
            for i in range(n):
                seen = np.array([counts.get(f"{kind}{i},{j}", 0.0) for j in range(prior.shape[1])])
                if seen.sum():
                    prior[i] = (prior[i] + weight * seen / seen.sum()) / (1 + weight)
    return np.log(start), np.log(move), np.log(emit)


def viterbi(symbols: str, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[int]:
    """The likeliest state of every line."""
    start, move, emit = (m.tolist() for m in model)
    states = range(len(start))
    where = [SYMBOLS.index(k) for k in symbols]
    score, back = [start[s] + emit[s][where[0]] for s in states], []
    for k in where[1:]:
        step = [max(states, key=lambda a: score[a] + move[a][b]) for b in states]
        score = [score[step[b]] + move[step[b]][b] + emit[b][k] for b in states]
        back.append(step)
    at = max(states, key=score.__getitem__)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def _symbol_table(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page_symbols(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int32()))], ["doc_id", "symbols", "words"]
            )

    rows = documents.where(F.col("path").isNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return for_all_cores(rows, "doc_id").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, symbols string, words array<int>")


def _corpus_counts(pages: DataFrame, model) -> dict[str, float]:
    """Moves and emissions on the Viterbi paths of all pages: at most states * (states + symbols) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for symbols, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = viterbi(symbols, model)
                for i, (s, k) in enumerate(zip(path, symbols)):
                    seen[key] = seen.get(key := f"e{s},{SYMBOLS.index(k)}", 0) + times
                    if i:
                        seen[key] = seen.get(key := f"t{path[i - 1]},{s}", 0) + times
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    spark = pages.sparkSession
    shapes = pages.where("symbols <> ''").groupBy("symbols").agg(F.count(F.lit(1)).alias("times"))
    # few bytes but much work: spread by number of rows, as the bytes alone would make one task of them
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = shapes.repartition(parts).mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: float(r["n"]) for r in rows}


def page_labels(documents: DataFrame, rounds: int = 1) -> DataFrame:
    """Words by line label for every text that is no file of a repository.

    Returns (doc_id, words, prose, links, tags, menu), one row per row of ``documents`` with a null ``path``;
    null, empty and blank texts have 0 words. ``rounds``: re-estimations of the model over
    all pages; none is needed for an empty table. Repeated rows stay repeated, a null ``doc_id``
    stays null, other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "pages")
    pages = scratch.save(_symbol_table(documents), "symbols")
    model = tables()
    for _ in range(rounds):
        model = tables(_corpus_counts(pages, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: list[list[int]] = [[] for _ in range(1 + len(STATES))]
            for symbols, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by = [0] * len(STATES)
                if symbols:
                    for s, n in zip(viterbi(symbols, model), words):
                        by[s] += n
                for column, n in zip(sums, [sum(by), *by]):
                    column.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in sums)], ["doc_id", "words", *STATES])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"doc_id {kind}, words bigint, " + ", ".join(f"{s} bigint" for s in STATES))


def spam_pages(documents: DataFrame, share: float = 0.5, rounds: int = 1) -> DataFrame:
    """(doc_id) of the pages with more than ``share`` of their words outside prose; a page without words is none."""
    labels = page_labels(documents, rounds)
    return labels.where((F.col("words") - F.col("prose")) > F.col("words") * share).select("doc_id")
