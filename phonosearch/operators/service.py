"""A search service over Spark tables: init, resolve, search, linked, page, cancel, with typed errors.

Scores by pronunciation are kept for each kind of search, so that a request that changes frequency or topic alone ranks them again. The last
searches can be paged; a new search supersedes the running one, whose jobs are stopped. While jobs of a search run, silence (no task
that ends) for too long stops them; a service that nobody asks anything has no clock.
"""

from __future__ import annotations

import itertools
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonosearch.functions.inventory import CODES as SOUNDS
from phonosearch.functions.inventory import decode
from phonosearch.functions.text import HANGUL
from phonosearch.operators import linked_search, topic, word_search
from phonosearch.operators.resolve import resolve
from phonosearch.plans.request import Request
from phonosearch.sources.store import IntegrityError

CODES = ("no_pronunciation", "no_splits", "search_cancelled", "search_superseded", "asset_unavailable", "asset_integrity", "stale_results", "unsupported_message", "search_timeout", "word_worker_failed")


class SearchError(RuntimeError):
    def __init__(self, code: str, message: str = "") -> None:
        assert code in CODES
        super().__init__(message or code)
        self.code = code


def phonetic_key(request: Request) -> Request:
    """What decides the phonetic scores: all of a request but frequency and topic, its own functions included."""
    return replace(request.normalized(), frequency_weight=0.0, topic_weight=None)


class Loader:
    """Loads once and shares the result; a failure is not kept, so the next call tries again."""

    def __init__(self, load: Callable[[], DataFrame]) -> None:
        self.load, self.value, self.lock = load, None, threading.Lock()

    def get(self) -> DataFrame:
        with self.lock:
            if self.value is None:
                try:
                    self.value = self.load()
                except IntegrityError as e:
                    raise SearchError("asset_integrity", str(e)) from e
                except Exception as e:
                    raise SearchError("asset_unavailable", str(e)) from e
            return self.value


@dataclass
class Found:
    """A search that can be paged: ranked rows, what orders ties, and what completes a page."""

    ranked: DataFrame
    order: tuple[str, ...]
    complete: Callable[[DataFrame], DataFrame]
    topic_missing: bool = False


@dataclass
class Job:
    number: int
    stopped: str | None = None  # the error code that its end has
    ended: threading.Event = field(default_factory=threading.Event)


class SearchService:
    """lexicon, edges, units (words of linked search) and topics (row_id, q, inv_norm) are loaded when they are first needed.

    A lexicon with a column topic_row can be searched with a topic; word search, linked search and topics share nothing else.
    """

    def __init__(self, lexicon, edges=None, units=None, topics=None, model: Callable | None = None, keep: int = 2, silence: float = 180.0) -> None:
        loader = lambda load: Loader(load) if load else None
        self.lexicon, self.edges, self.units, self.topics = map(loader, (lexicon, edges, units, topics))
        self.model, self.keep, self.silence = model, keep, silence
        self.results: OrderedDict[int, Found] = OrderedDict()
        self.raw: dict[str, tuple[object, DataFrame]] = {}
        self.numbers, self.lock = itertools.count(1), threading.Lock()
        self.job: Job | None = None

    def handle(self, message: dict):
        """One message {type, ...}; any other type is an error of its own."""
        found = {"init": self.init, "resolve": self.resolve, "search": self.search, "linked": self.linked, "page": self.page, "cancel": self.cancel}.get(message.get("type"))
        if found is None:
            raise SearchError("unsupported_message", str(message.get("type")))
        return found(**{k: v for k, v in message.items() if k != "type"})

    # ---- jobs

    def begin(self) -> Job:
        """A new search's number; the running search is superseded and its jobs end."""
        with self.lock:
            before, self.job = self.job, Job(next(self.numbers))
            if before and not before.ended.is_set():
                self.stop(before, "search_superseded")
            return self.job

    def stop(self, job: Job, code: str) -> None:
        job.stopped = job.stopped or code
        session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        session.sparkContext.cancelJobsWithTag(f"search-{job.number}")

    @contextmanager
    def running(self, job: Job):
        """Runs jobs under the search's tag; what ends them early becomes an error code."""
        session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        tag = f"search-{job.number}"
        done = threading.Event()
        threading.Thread(target=self.watch, args=(job, session.sparkContext, done), daemon=True).start()
        session.sparkContext.addJobTag(tag)
        try:
            if job.stopped:
                raise SearchError(job.stopped)
            yield
            if job.stopped:
                raise SearchError(job.stopped)
        except SearchError:
            raise
        except Exception as e:
            raise SearchError(job.stopped or "word_worker_failed", str(e)[:500]) from e
        finally:
            done.set()
            session.sparkContext.removeJobTag(tag)

    def watch(self, job: Job, context, done: threading.Event) -> None:
        """Stops a job after too long a silence: no task of any stage has ended."""
        signs, since = None, time.monotonic()
        while not done.wait(min(1.0, self.silence / 4)):
            tracker = context.statusTracker()
            now = sorted((s, i.numCompletedTasks) for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s)))
            if now != signs:
                signs, since = now, time.monotonic()
            elif time.monotonic() - since > self.silence:
                self.stop(job, "search_timeout")
                return

    def scored(self, kind: str, key, make: Callable[[], DataFrame]) -> DataFrame:
        """The phonetic scores of the last search of a kind, kept if the key is the same."""
        if kind not in self.raw or self.raw[kind][0] != key:
            if kind in self.raw:
                self.raw[kind][1].unpersist()
            self.raw[kind] = (key, make().persist())
        return self.raw[kind][1]

    def finished(self, job: Job, found: Found) -> tuple[int, list]:
        """Keeps a search's result and gives its number and first page."""
        rows = self.rows(found, 0, word_search.PAGE)
        if job.stopped:
            raise SearchError(job.stopped)
        self.results[job.number] = found
        while len(self.results) > self.keep:
            self.results.popitem(last=False)
        return job.number, rows

    def rows(self, found: Found, offset: int, count: int) -> list:
        return found.complete(word_search.page(found.ranked, offset, count, found.order)).orderBy("rank").collect()  # at most `count` rows

    def similarities(self, word: str | None) -> DataFrame | None:
        """row_id, similarity of all topic rows with a word's; None where the word has no row."""
        if word is None:
            return None
        if self.topics is None or "topic_row" not in self.lexicon.get().columns:
            raise SearchError("asset_unavailable", "no topics")
        row = topic_row(self.lexicon.get(), word)
        return None if row is None else topic.similarity_to(self.topics.get(), row)

    # ---- messages

    def init(self) -> dict:
        """Loads the lexicon; how many words of each language it has."""
        return {r.lang: r["count"] for r in self.lexicon.get().groupBy("lang").count().collect()}  # a row for each language

    def resolve(self, text: str) -> dict:
        """A query's sounds: native, koreanized, tokens, sources, skipped."""
        lexicon = self.lexicon.get()
        q = lexicon.sparkSession.createDataFrame([(0, text)], "query_id int, text string")
        found = resolve(q, lexicon, SOUNDS, self.model).first()
        if found is None or not found.native:
            raise SearchError("no_pronunciation", text)
        return {"native": decode(found.native), "koreanized": decode(found.koreanized), "tokens": found.tokens, "sources": found.sources, "skipped": found.skipped}

    def search(self, request: Request, topic_word: str | None = None) -> tuple[int, list]:
        """(search id, first page). With a topic that has no vector the search goes on without it; missing_topic(id) tells."""
        if not request.native:
            raise SearchError("no_pronunciation")
        job = self.begin()
        try:
            lexicon = self.lexicon.get()
            with self.running(job):
                raw = self.scored("word", phonetic_key(request), lambda: word_search.score_raw(lexicon, request).where(F.col("raw") > word_search.THRESHOLD))
                similar = self.similarities(topic_word)
                if topic_word is not None and similar is None:
                    request = replace(request, topic_weight=None)
                elif similar is not None:
                    raw = raw.join(similar.withColumnRenamed("row_id", "topic_row"), "topic_row", "left")
                ranked = word_search.rank(raw, request)
                return self.finished(job, Found(ranked, ("ord",), lambda page: word_search.explain(page, request), topic_word is not None and similar is None))
        finally:
            job.ended.set()

    def linked(self, request: Request, which: str, layers: tuple[str, ...]) -> tuple[int, list]:
        """(search id, first page) of pairs of neighbouring words, with both texts, the pair's zipf and its split."""
        if self.edges is None or self.units is None:
            raise SearchError("asset_unavailable", "no edges")
        if not request.native:
            raise SearchError("no_pronunciation")
        job = self.begin()
        try:
            units, edges = self.units.get(), self.edges.get()
            plan = linked_search.splits(request, which)
            if not plan:
                raise SearchError("no_splits")
            with self.running(job):
                side = lambda name, z: units.select(F.col("id").alias(name), F.col("text").alias(f"{name}_text"), F.coalesce("zipf", F.lit(1.0)).alias(z))

                def make() -> DataFrame:
                    pairs, _ = linked_search.collect(units, edges, request, which, layers)
                    both = pairs.join(side("first", "za"), "first").join(side("second", "zb"), "second")
                    return both.withColumn("zipf", (F.col("za") + F.col("zb")) / 2).drop("za", "zb")

                pairs = self.scored("linked", (phonetic_key(request), which, layers), make)
                ranked = linked_search.rank(pairs, replace(request, topic_weight=None))
                return self.finished(job, Found(ranked, ("first", "second"), lambda page: linked_search.describe(page, plan)))
        finally:
            job.ended.set()

    def page(self, number: int, offset: int = 0, count: int = word_search.PAGE) -> list:
        found = self.results.get(number)
        if found is None:
            raise SearchError("stale_results")
        return self.rows(found, offset, count)

    def missing_topic(self, number: int) -> bool:
        return number in self.results and self.results[number].topic_missing

    def cancel(self, number: int) -> None:
        """Stops a running search; one that has ended stays."""
        with self.lock:
            if self.job and self.job.number == number and not self.job.ended.is_set():
                self.stop(self.job, "search_cancelled")


def topic_row(lexicon: DataFrame, word: str) -> int | None:
    """The topic row of a word: a Korean one if it is written in Hangul, else an English one; None where it has none."""
    lang = "ko" if lexicon.sparkSession.range(1).select(F.lit(word).rlike(HANGUL)).first()[0] else "en"
    found = lexicon.where((F.col("lang") == lang) & (F.lower("word") == word.strip().lower()) & (F.col("topic_row") >= 0)).agg(F.min("topic_row")).first()
    return found[0]
