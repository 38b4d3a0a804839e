"""The engine's commands over a store: index, hash, fulltext, search, find, tag, tags, browse, status, explain.

Every command plans on the driver and runs as DataFrame jobs; only answers of bounded size come back.
"""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cairn.adapters import FILES
from cairn.functions import fixed, formats, names, paths
from cairn.operators import browse, fresh, fulltext, scan, tags
from cairn.plans.policy import DeltaCache, ExcludePolicy, Marker, TextPolicy, journal_probe, stale_notice
from cairn.plans.rules import Rule, parse_rules, parse_tag
from cairn.plans.search import live_terms, parse
from cairn.report import Outcome, event, ledger_holds, next_command, next_step_reason, share_pct, status_warnings
from cairn.sources import documents
from cairn.sources.fs import crawl
from cairn.sources.shared import LAYOUT
from cairn.sources.store import Store, behind

#: Messages of a scan that its report shows at most.
ERROR_SAMPLES = 5


@dataclass
class Answer:
    """What a command returns: an outcome, its rows (bounded) and its report."""

    outcome: Outcome
    rows: list = field(default_factory=list)
    report: dict = field(default_factory=dict)
    notice: str | None = None

    def lines(self, kind: str) -> list[str]:
        return [event(kind, **(r.asDict(True) if hasattr(r, "asDict") else r)) for r in self.rows] + [event(f"{kind}_summary", outcome=int(self.outcome), notice=self.notice, **self.report)]


def _looked_up(page: list[Row]) -> list[Row]:
    """The rows of a page (not of a selection) with whether each path is there now."""
    return [Row(**r.asDict(), there=bool(r.path) and os.path.exists(r.path)) for r in page]


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self._cache = DeltaCache()
        self.delta_limit = fresh.DELTA_LIMIT

    # --- writing -----------------------------------------------------------------------------------------------------

    def index(self, root: str, policy: ExcludePolicy | None = None) -> Answer:
        """Scans a tree. The marker is taken before the walk, so that what changes meanwhile counts as changed. The engine's own store is never scanned."""
        policy = policy or ExcludePolicy()
        marker = Marker("mtime", time.time_ns())
        entries = crawl(self.spark, root, list(policy.prefixes)).persist()
        marked = entries.withColumn("reason", F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.coalesce(self._excluded(root, policy), F.lit(""))))
        counts = {r.reason: r.n for r in marked.groupBy("reason").agg(F.count("*").alias("n")).collect()}
        samples = [r.error for r in scan.error_samples(marked.where("reason = 'error'"), ERROR_SAMPLES).collect()]
        found = marked.where("reason = ''").select("path", "ext", "size", "mtime_ns", "ctime_ns", "fs_id")
        stored = self.files() if self.store.has("files") else self.spark.createDataFrame([], FILES)
        n = self.store.scan_generation + 1
        first = (stored.agg(F.max("file_id")).first()[0] or 0) + 1
        classes = scan.classify(found, stored).persist()
        ledger = {r["class"]: r.n for r in scan.ledger(classes, scan.tombstones(stored, classes, n)).collect()}
        meta = {"root": root, "marker": marker.encode(), "policy": policy.encode(), "scan_errors": str(counts.get("error", 0)), "scan_generation": str(n)}
        self.store.commit({"files": scan.apply_rescan(found, stored, n, first, classes)}, meta)
        classes.unpersist()
        entries.unpersist()
        self._cache.drop()
        indexed, errors, total = counts.get("", 0), counts.get("error", 0), sum(counts.values())
        assert ledger_holds(total, indexed, total - indexed - errors, errors)
        report = {"scanned": total, "indexed": indexed, "skipped": total - indexed - errors, "errors": errors, **{k: v for k, v in counts.items() if k not in ("", "error")}, **ledger}
        return Answer(Outcome.ANSWER if indexed else Outcome.UNUSABLE, report=report | ({"error_samples": samples} if samples else {}))

    def _excluded(self, root: str, policy: ExcludePolicy):
        own = re.sub("^file:/*", "/", self.store.root)
        hidden = F.col("attributes") if policy.skip_hidden else None
        return scan.exclusion(paths.relative_path(F.col("path"), root), F.col("path"), policy.names, policy.prefixes, policy.ignored, hidden, os.path.abspath(own) if own.startswith("/") or "://" not in own else None)

    def hash(self, max_bytes: int = 4 << 20) -> Answer:
        """Fills content hashes and first bytes of files that have none; doing it again changes nothing."""
        files = self.files()
        read = documents.read_contents(scan.unhashed(files).where(F.col("size") <= max_bytes), max_bytes).withColumnRenamed("content", "body")
        filled = scan.hash_backfill(read, max_bytes).drop("body")
        rest = files.join(filled.select("file_id"), "file_id", "left_anti")
        self.store.commit({"files": rest.unionByName(filled)})
        return Answer(Outcome.ANSWER, report=self._stats())

    def fulltext(self, max_bytes: int = fixed.MAX_BODY_BYTES, policy: TextPolicy | None = None, sniff: bool = True) -> Answer:
        """Builds the postings; every candidate is indexed or counted with a reason."""
        policy, notice = TextPolicy.resolve(policy, self.store.meta("text_policy"))
        read = documents.read_contents(scan.live(self.files()), max_bytes)
        got = documents.extract(read.select("file_id", "path", "ext", "size", "content"), with_content=True).withColumnRenamed("body", "extracted")
        verdict = formats.ext_verdict(F.col("ext"), list(policy.text), list(policy.binary))
        head = F.substring("content", 1, fixed.SNIFF_BYTES)
        # Blanks between CJK letters are what a layout leaves in a parser's text.
        body = F.when(verdict == "extract", fulltext.without_kerning_blanks(F.col("extracted"))).otherwise(documents.decoded(F.col("content")))
        kind = (
            F.when(F.col("size") == 0, "empty").when(F.col("size") > max_bytes, "too_large").when(F.col("content").isNull(), "unreadable").when(verdict == "binary", "unsupported")
            .when((verdict == "unknown") & ~(F.lit(sniff) & formats.sniff_is_text(head)), "binary" if sniff else "unsupported")
            .when((verdict == "extract") & F.col("error").isNotNull(), "extract_failed").when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty").otherwise("indexed")
        )
        rows = got.select("file_id", "path", kind.alias("verdict"), body.alias("body")).persist()
        docs = rows.where("verdict = 'indexed'").select("file_id", "path", "body")
        tables = {
            "bodies": docs, "postings": lambda new: fulltext.postings(new("bodies")),
            "terms": lambda new: fulltext.terms_in_order(new("postings")),
            "corpus": lambda new: fulltext.corpus_row(new("bodies"), new("terms")),
        }
        self.store.commit(tables, {"text_policy": policy.encode()}, LAYOUT)
        text_bytes = rows.where("verdict = 'indexed'").agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
        sizes = {"index_bytes": self.store.size("postings") + self.store.size("terms"), "text_bytes": text_bytes}
        ledger = {r.verdict: r.n for r in rows.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        rows.unpersist()
        return Answer(Outcome.ANSWER if ledger.get("indexed") else Outcome.UNUSABLE, rows=[sizes], report=ledger, notice=notice)

    def refresh(self) -> Answer:
        """Brings the full-text index up to what has changed since the scan, without reading the other files: changed and gone files lose their postings, changed ones that the index knows get new ones. Files new to the store wait for the next scan, which gives them ids."""
        changes, notice = self.delta()
        if changes is None or notice:
            return Answer(Outcome.UNUSABLE, notice=notice)
        known = scan.live(self.files()).select("file_id", "path")
        touched = changes.join(known, "path").select("file_id", "path", "exists").persist()
        read = documents.read_contents(touched.where("exists"), fixed.MAX_BODY_BYTES).where("content is not null")
        now = read.select("file_id", "path", documents.decoded(F.col("content")).alias("body")).where(F.trim("body") != "")
        now = now.join(self.store.table("bodies").select("file_id"), "file_id", "left_semi")
        old = self.store.table("bodies").join(touched.select("file_id"), "file_id", "left_anti")
        index = self.store.table("postings")
        tables = {
            "bodies": old.unionByName(now), "postings": lambda new: fulltext.in_order(fulltext.updated(index, touched, now.select("file_id", "body"))),
            "terms": lambda new: fulltext.terms_in_order(new("postings")),
            "corpus": lambda new: fulltext.corpus_row(new("bodies"), new("terms")),
        }
        self.store.commit(tables, None, LAYOUT)
        n = touched.count()
        touched.unpersist()
        return Answer(Outcome.ANSWER if n else Outcome.EMPTY, report={"touched": n})

    def tag(self, config: str = "", read_magic: bool = True, read_embedded: bool = True, embedded_max: int = 64 << 20, magic_max: int | None = None) -> Answer:
        """Builds the tag layer whole; rules are the text of a configuration."""
        rules, digest = parse_rules(config) if config else ([], "")
        facts = self._facts(read_magic, read_embedded, embedded_max, magic_max=magic_max)
        all_tags = tags.generate(facts, self.store.meta("root"), rules).persist()
        kept, dropped = tags.cap(all_tags)
        known, rows = tags.intern(kept)
        self.store.commit({"tags": known, "file_tags": rows}, {"tag_generation": str(self.store.scan_generation), "rules": digest, "rules_text": config})
        n_dropped = dropped.count()
        all_tags.unpersist()
        cover = [r.asDict() for r in tags.coverage(scan.live(self.files()), self.tagged()).collect()]
        return Answer(Outcome.ANSWER if cover else Outcome.UNUSABLE, rows=cover, report={"dropped": n_dropped})

    def _facts(self, read_magic: bool, read_embedded: bool, embedded_max: int, files: DataFrame | None = None, magic_max: int | None = None) -> DataFrame:
        f = scan.live(self.files()) if files is None else files
        if not (read_magic or read_embedded):
            return f.select("file_id", "path", "ext", "magic")
        read = documents.read_contents(f.select("file_id", "path", "ext", "magic", "size"), embedded_max)
        magic = F.coalesce("magic", F.substring("content", 1, fixed.SNIFF_BYTES)) if read_magic else F.col("magic")
        if magic_max is not None:
            magic = F.when(F.col("size") <= magic_max, magic).otherwise(F.col("magic"))
        out = read.withColumn("magic", F.when((F.col("size") > 0) | F.col("magic").isNotNull(), magic))
        if not read_embedded:
            return out.select("file_id", "path", "ext", "magic")
        # One read of each file: those without embedded metadata pass through, the others by their parser.
        has_meta = F.coalesce(F.col("ext").isin(fixed.META_EXTS), F.lit(False))
        out = out.withColumn("content", F.when(has_meta, F.col("content"))).withColumn("ext_read", F.when(has_meta, F.col("ext"))).select("file_id", "path", "magic", F.col("ext").alias("ext_known"), F.col("ext_read").alias("ext"), "content")
        out = documents.extract(out)
        date = names.iso_date(F.col("date"))
        authors = F.array_distinct(F.array_compact(F.transform("authors", names.cleaned)))
        embedded = F.when(F.col("ext").isNotNull(), F.struct(authors.alias("authors"), names.cleaned(F.col("title")).alias("title"), names.cleaned(F.col("camera")).alias("camera"), date.alias("date")))
        return out.select("file_id", "path", F.col("ext_known").alias("ext"), "magic", embedded.alias("embedded"))

    # --- tables ------------------------------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        return self.store.table("files")

    def tagged(self) -> DataFrame:
        """Tag rows of live files."""
        rows = self.store.table("file_tags").join(self.store.table("tags"), "tag_id")
        return rows.join(scan.live(self.files()).select("file_id"), "file_id", "left_semi").select("file_id", "namespace", "value", "sources")

    def delta(self, limit: int | None = None) -> tuple[DataFrame | None, str | None]:
        """(change set since the last scan, notice)."""
        marker = Marker.decode(self.store.meta("marker") or "")
        try:
            policy = ExcludePolicy.decode(self.store.meta("policy") or "v2\nhidden=0")
        except ValueError as e:
            return None, stale_notice(str(e), marker, True, "complete")
        if marker is None:
            return None, stale_notice(None, None, True, "complete")
        root = self.store.meta("root")

        def changed() -> DataFrame:
            now = crawl(self.spark, root, list(policy.prefixes)).where("error is null")
            now = now.where(self._excluded(root, policy).isNull())
            return fresh.delta(now, self.files(), marker.recorded_ns)

        changes = self._cache.get(marker, time.monotonic(), changed)
        cut, status = fresh.truncated(changes, limit or self.delta_limit)
        return cut, stale_notice(None, marker, True, status.first().status)

    def probe(self) -> str | None:
        """Whether files have changed since the layers were made, as a notice: said beside an answer, never mixed into its counts."""
        changes, notice = self.delta()
        if notice or changes is None:
            return notice
        n = changes.count()
        return f"{n} files have changed since the last scan; counts are the layer's" if n else None

    # --- reading -----------------------------------------------------------------------------------------------------

    def find(self, text: str, limit: int = 20, fresh_answer: bool = True) -> Answer:
        changes, notice = self.delta() if fresh_answer else (None, stale_notice(None, Marker.decode(self.store.meta("marker") or ""), False, ""))
        rows = _looked_up((scan.find_paths(self.files(), text, limit) if changes is None else fresh.find(self.files(), changes, text, limit)).collect())
        return Answer(Outcome.ANSWER if rows else Outcome.EMPTY, rows, {"n": len(rows)}, notice)

    def search_index(self, query: str, limit: int = 10, snippet_chars: int = 160) -> Answer:
        """The index alone answers, with the paths that files had when it was built."""
        hits = fulltext.search(self._index(), query, limit)
        words = list(live_terms(parse(query)).body_terms)
        page = hits.join(self.store.table("bodies"), "file_id").orderBy(F.desc("score"), "file_id")
        rows = page.select("file_id", "score", "path", fulltext.snippet(F.col("body"), words, snippet_chars).alias("snippet")).collect()
        return Answer(Outcome.ANSWER if rows else Outcome.EMPTY, rows, {"n": len(rows)}, "from the index alone: paths and texts are those of its making")

    def _index(self) -> fulltext.TextIndex:
        return fulltext.TextIndex(*map(self.store.table, ("postings", "terms", "corpus")))

    def search(self, query: str, limit: int = 10, snippet_chars: int = 160, fresh_answer: bool = True, policy: TextPolicy | None = None) -> Answer:
        """A page of hits with snippets; changed files are read as the index's text policy says. `stages` are seconds: what is planned and probed, and what the page itself takes."""
        began = time.monotonic()
        policy, unlike = TextPolicy.resolve(policy, self.store.meta("text_policy"))
        hits = fulltext.search(self._index(), query, limit if not fresh_answer else None)
        terms = live_terms(parse(query)).body_terms
        changes, notice = self.delta() if fresh_answer else (None, stale_notice(None, Marker.decode(self.store.meta("marker") or ""), False, ""))
        probed = time.monotonic()
        indexed = self.store.table("bodies").select("file_id", "body")
        if changes is None:
            best = hits if not fresh_answer else hits.orderBy(F.desc("score"), "file_id").limit(limit)
            page = fulltext.resolve(best, self.files()).join(indexed, "file_id", "left").orderBy(F.desc("score"), "file_id")
        else:
            now = documents.read_contents(changes.where("exists"), fixed.MAX_BODY_BYTES).where("content is not null")
            verdict = formats.ext_verdict(paths.extension(paths.file_name(F.col("path"))), list(policy.text), list(policy.binary))
            text = (verdict == "text") | ((verdict == "unknown") & formats.sniff_is_text(F.substring("content", 1, fixed.SNIFF_BYTES)))
            bodies = now.where(text).select("path", documents.decoded(F.col("content")).alias("body"))
            page = fresh.search(hits, self.files(), changes, bodies, query, limit)
            page = page.join(indexed.withColumnRenamed("body", "old"), "file_id", "left").join(bodies, "path", "left").withColumn("body", F.coalesce("body", "old")).orderBy("place")
        rows = page.select(*[c for c in page.columns if c not in ("body", "old")], fulltext.snippet(F.col("body"), list(terms), snippet_chars).alias("snippet")).collect()
        rows = _looked_up(rows)
        stages = {"probe": round(probed - began, 3), "page": round(time.monotonic() - probed, 3)}
        return Answer(Outcome.ANSWER if rows else Outcome.EMPTY, rows, {"n": len(rows), "stages": stages}, notice or unlike)

    def tags(self, words: list[str] = (), limit: int = 20, fresh_answer: bool = True) -> Answer:
        """No words: namespaces; `ns:`: its values; tags: the files that have all of them, each with whether it is there now."""
        t = self.tagged()
        if not words:
            rows = tags.namespace_counts(t).limit(limit).collect()
        elif len(words) == 1 and words[0].endswith(":"):
            rows = tags.tag_counts(t, words[0][:-1].strip().lower(), limit).collect()
        else:
            found = tags.files_with(t, [parse_tag(w) for w in words])
            page = scan.live(self.files()).join(found, "file_id", "left_semi").select("file_id", "path").orderBy("file_id").limit(limit).collect()
            rows = _looked_up(page)
        return Answer(Outcome.ANSWER if rows else Outcome.EMPTY, rows, {"n": len(rows), "behind": self._behind()}, self.probe() if fresh_answer else None)

    def _behind(self) -> int:
        return behind(self.store.scan_generation, int(self.store.meta("tag_generation") or 0))

    def explain(self, path: str, config: str | None = None) -> Answer:
        """The stored tags of one file beside those that it would get now."""
        one = scan.live(self.files()).where(F.col("path") == path)
        rules: list[Rule] = parse_rules(config if config is not None else (self.store.meta("rules_text") or ""))[0]
        stored = self.tagged().join(one.select("file_id"), "file_id", "left_semi").select("namespace", "value", F.col("sources").alias("stored"))
        now = tags.generate(self._facts(True, True, 64 << 20, one), self.store.meta("root"), rules).select("namespace", "value", F.col("sources").alias("now"))
        both = stored.join(now, ["namespace", "value"], "full_outer").withColumn("from", tags.describe_sources(F.coalesce("now", "stored")))
        rows = both.orderBy("namespace", "value").limit(2 * fixed.MAX_TAGS).collect()
        return Answer(Outcome.ANSWER if rows else Outcome.EMPTY, rows)

    def browse(self, words: list[str] = (), axes: int = browse.AXES, values: int = browse.VALUES, label_terms: int = browse.LABEL_TERMS, preview: int = browse.PREVIEW, fresh_answer: bool = True) -> Answer:
        """A drill-down step. Counts are the layer's; what changed since is said in the notice, never mixed into them."""
        chosen = [parse_tag(w) for w in words]
        if not self.store.has("tags"):
            return Answer(Outcome.UNUSABLE, notice=next_step_reason(False, 0, 0, None))
        view = browse.browse(self.tagged(), chosen, axes, values, label_terms, preview)
        flags = {k: v for k, v, d in (("axes", axes, browse.AXES), ("values", values, browse.VALUES), ("label-terms", label_terms, browse.LABEL_TERMS), ("files", preview, browse.PREVIEW)) if v != d}
        report = {"view": view, "behind": self._behind(), "next": next_command(chosen, view.recommended, flags), "why": next_step_reason(True, view.matched, len(view.axes), view.recommended)}
        report["shares"] = {f"{v.namespace}:{v.value}": share_pct(v.n_files, view.matched) for v in view.values}
        return Answer(Outcome.ANSWER if view.matched else Outcome.EMPTY, report=report, notice=self.probe() if fresh_answer else None)

    def _stats(self) -> dict:
        none = self.spark.createDataFrame([], "file_id bigint, tag_id bigint, sources int")
        return scan.index_stats(self.files(), self.store.table("file_tags") if self.store.has("file_tags") else none).first().asDict()

    def status(self, check_journal: bool = False, warn_hours: float = 24, journal: dict | None = None) -> Answer:
        """What the store holds. `journal` is the state of a change journal where the system has one: journal, first_usn, next_usn, maximum_size."""
        if not self.store.has("files"):
            return Answer(Outcome.UNUSABLE, notice="no store: index first")
        stats = self._stats()
        try:
            policy = "present" if self.store.meta("policy") and ExcludePolicy.decode(self.store.meta("policy")) else "not_recorded"
        except ValueError:
            policy = "unreadable"
        late = self._behind() if self.store.has("tags") else 0
        marker = Marker.decode(self.store.meta("marker") or "")
        checks, why = journal_probe(check_journal, marker, journal is not None)
        told, verdict, hours = {"checked": checks, "reason": why}, None, None
        if checks:
            row = {"id": 0, "next_usn": marker.next_usn, "recorded_ns": marker.recorded_ns, "live_next_usn": journal["next_usn"], "first_usn": journal["first_usn"], "maximum_size": journal["maximum_size"], "now_ns": time.time_ns()}
            life = fresh.marker_lifetime(self.spark.createDataFrame([row], ", ".join(f"{k} bigint" for k in row)))
            life = life.withColumn("verdict", fresh.journal_verdict(F.lit(marker.journal), F.col("next_usn"), F.lit(journal["journal"]), F.col("first_usn"))).first()
            verdict, hours = life.verdict, None if life.remaining_s is None else life.remaining_s / 3600
            told |= {"verdict": verdict, "remaining_hours": hours}
        report = {**stats, "generation": self.store.generation, "scans": self.store.scan_generation, "policy": policy, "journal": told}
        return Answer(Outcome.ANSWER, report={**report, "warnings": status_warnings(stats, late, policy, verdict, hours, warn_hours)})
