"""Input tables made of the given ones, in Spark.

The given tables hold no repositories, so customers stand in for repositories, orders for commits,
line items for changed files and for the files of a tree, documents and pages for single sources.
``checks.oracle`` defines the same views in SQL.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.rules.licenses import TEXTS
from checks.ruled_paths import CASES
from checks.snippets import CASES as SNIPPETS
from tallyforge.operators.license import public_corpus
from tallyforge.plans.analyze import Portfolio

NOW = "2001-08-31 10:00:00"  # a 31st, so that six months before runs over into March
CORPUS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]


def text(column: str) -> Column:
    return F.col(column).cast("string")


class Standin:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def repos(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        slug = F.replace("c_name", F.lit("#"), F.lit("-"))
        url = F.concat(F.lit("https://git.example/"), "n_name", F.lit("/"), slug)
        key = F.col("c_custkey")
        subgroup = F.concat("n_name", F.lit("/"), "c_mktsegment")
        return self.table("customer").join(nation, "c_nationkey").select(
            text("c_custkey").alias("repo"),
            F.when(key % 3 == 0, "github").when(key % 3 == 1, "gitlab").otherwise("bitbucket").alias("provider"),
            slug.alias("slug"),
            F.col("c_name").alias("name"),
            F.when(key % 3 == 1, subgroup).otherwise(F.col("c_mktsegment")).alias("project"),
            url.alias("url"),
            F.concat(url, F.lit(".git")).alias("clone_url"),
            F.lit("").alias("download_url"),
            F.lit("main").alias("default_branch"),
            (F.col("c_acctbal") < 0).alias("archived"),
            (key % 10 == 0).alias("fork"),
        )

    def commits(self) -> DataFrame:
        key = F.col("o_orderkey")
        ts = F.col("o_orderdate").cast("timestamp")
        author = F.when(key % 13 == 0, F.lit("helper[bot] <Helper@bots.example>")).otherwise(
            F.concat(F.lit("Dev <DEV"), (key % 3).cast("string"), F.lit("@E.com>"))
        )
        title = F.concat(F.lit("Change "), text("o_orderkey"))
        message = (
            F.when(key % 11 == 0, F.concat(title, F.lit("\n\n  Co-Authored-By: Claude <x@example.com>")))
            .when(key % 11 == 1, F.concat(F.lit("AI-Generated fix "), text("o_orderkey"), F.lit("\nmore")))
            .when(key % 11 == 2, F.concat(title, F.lit("\nCo-Authored-By: Jo Doe <jo@example.com>")))
            .otherwise(title)
        )
        return self.table("orders").select(
            text("o_custkey").alias("repo"),
            text("o_orderkey").alias("hash"),
            author.alias("author"),
            message.alias("message"),
            ts.alias("ts"),
            # The two clocks disagree by up to 160 days.
            (ts + F.make_dt_interval(((key % 5) * 40).cast("int"))).alias("committer_ts"),
            F.lit(None).cast("bigint").alias("seq"),
        )

    def _lines(self) -> DataFrame:
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), text("o_custkey").alias("repo"))
        return self.table("lineitem").join(orders, "l_orderkey")

    def _spread_lines(self) -> DataFrame:
        """The same, partitioned for the join whatever its kind: the small tables are one row group each."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), text("o_custkey").alias("repo"))
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return lines.repartition(partitions, "l_orderkey").join(orders, "l_orderkey")

    def commit_files(self) -> DataFrame:
        return self._lines().select(
            "repo",
            text("l_orderkey").alias("hash"),
            F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("path"),
            F.col("l_quantity").cast("bigint").alias("additions"),
            F.col("l_linenumber").cast("bigint").alias("deletions"),
        )

    def commit_stats(self) -> DataFrame:
        """Orders without line items have none."""
        sums = self.commit_files().groupBy("repo", "hash").agg(
            F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
        )
        return sums.withColumn("error", F.lit(None).cast("string"))

    def complexity(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        path = F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"))
        return (
            self._lines()
            .join(part, "l_partkey")
            .groupBy("repo", path.alias("path"))
            .agg(F.sum("p_size").alias("complexity"))
        )

    def trees(self) -> DataFrame:
        """A file per line item in the tree of its order, with code, comment and blank lines by its numbers."""
        part, number = F.col("l_partkey"), F.col("l_linenumber")
        kind = part % 5
        stem = F.concat(F.lit("p"), (part % 50).cast("string"), F.lit("_"), text("l_linenumber"))
        folder = F.when(part % 19 == 0, F.lit("vendor/lib/")).otherwise(F.lit(""))
        suffix = (
            F.when(part % 17 == 0, F.lit(".pb.go"))
            .when(kind == 0, F.lit(".py"))
            .when(kind == 1, F.lit(".go"))
            .when(kind == 2, F.lit(".html"))
            .when(kind == 3, F.lit(".sql"))
            .otherwise(F.lit(".zzz"))
        )
        size = F.col("l_quantity").cast("int")
        block = F.repeat(F.lit("\n"), number)
        body = (
            F.when(kind == 0, F.concat(F.repeat(F.lit("if x == y:\n"), size), F.repeat(F.lit("# note\n"), number)))
            .when(kind == 1, F.concat(F.repeat(F.lit("x := a && b\n"), size), F.lit("/* note"), block, F.lit("*/\n")))
            .when(kind == 2, F.concat(F.repeat(F.lit("<p>\n"), size), F.lit("<!--"), block, F.lit("-->\n")))
            .otherwise(F.concat(F.repeat(F.lit("select 1\n"), size), F.repeat(F.lit("-- note\n"), number)))
        )
        return self._spread_lines().select(
            "repo",
            text("l_orderkey").alias("commit_hash"),
            F.concat(folder, stem, suffix).alias("path"),
            F.concat(body, F.repeat(F.lit("\n"), number % 3)).cast("binary").alias("content"),
        )

    def head_files(self) -> DataFrame:
        """All trees of a repository side by side, as its present files."""
        return self.trees().select(
            "repo",
            F.lit(None).cast("string").alias("commit_hash"),
            F.concat(F.lit("c"), "commit_hash", F.lit("/"), "path").alias("path"),
            "content",
        )

    def documents(self) -> DataFrame:
        """Documents and pages as sources of the collection they come from."""
        doc = F.col("doc_id")
        folder = F.when(doc % 7 == 0, F.lit("vendor/lib/")).when(doc % 7 == 1, F.lit("src/")).otherwise(F.lit(""))
        suffix = (
            F.when(doc % 11 == 0, F.lit(".pb.go"))
            .when(doc % 13 == 0, F.lit(".js"))
            .when(F.col("lang") == "en", F.lit(".py"))
            .when(F.col("lang") == "de", F.lit(".go"))
            .when(F.col("lang") == "fr", F.lit(".ts"))
            .otherwise(F.lit(".zzz"))
        )
        docs = self.table("documents").select(
            F.col("source").alias("repo"),
            F.concat(folder, F.lit("doc"), text("doc_id"), suffix).alias("path"),
            F.col("text").cast("binary").alias("content"),
        )
        pages = self.table("pages").select(
            F.split_part("url", F.lit("/"), F.lit(3)).alias("repo"),
            F.concat(F.lit("site/page"), text("page_id"), F.lit(".html")).alias("path"),
            F.replace("html", F.lit(">"), F.lit(">\n")).cast("binary").alias("content"),
        )
        return docs.unionByName(pages)

    def ruled_files(self) -> DataFrame:
        """Every document as a file of a repository of its own, in a place that the rules of file classes speak of."""
        cases = self.spark.createDataFrame([(i, path, added) for i, (path, added, _) in enumerate(CASES)], "kind long, path string, added string")
        docs = self.table("documents").select("doc_id", "text", (F.col("doc_id") % len(CASES)).alias("kind"))
        return docs.join(F.broadcast(cases), "kind").select(
            F.concat(F.lit("doc"), text("doc_id")).alias("repo"), "path", F.concat("text", "added").cast("binary").alias("content")
        )

    def ambiguous_files(self) -> DataFrame:
        """Every document with a text after it that speaks for one of several languages; a few are scripts."""
        cases = self.spark.createDataFrame([(i, *case) for i, case in enumerate(SNIPPETS)], "kind long, extension string, added string")
        docs = self.table("documents").select("doc_id", "text", (F.col("doc_id") % len(SNIPPETS)).alias("kind"))
        script = F.when(F.col("doc_id") % 50 == 0, "#!/usr/bin/env swipl\n").otherwise("")
        return docs.join(F.broadcast(cases), "kind").select(
            F.concat(F.lit("doc"), text("doc_id")).alias("repo"), F.concat(F.lit("src/a"), "extension").alias("path"),
            F.concat(script, "text", F.lit("\n"), "added").cast("binary").alias("content"),
        )

    def license_candidates(self) -> DataFrame:
        """License files, and every document as the license file of a repository of its own."""
        return self.license_files().unionByName(self.document_files())

    def document_files(self) -> DataFrame:
        return self.table("documents").select(
            F.concat(F.lit("doc"), text("doc_id")).alias("repo"), F.lit("LICENSE").alias("path"), F.col("text").cast("binary").alias("content")
        )

    def notices(self) -> DataFrame:
        """One sentence for each license."""
        return self.spark.createDataFrame(CORPUS, "spdx string, text string")

    def corpus(self) -> DataFrame:
        """Full texts of licenses."""
        return public_corpus(self.spark)

    def license_files(self) -> DataFrame:
        """A license for each repository, signed by it; in most of them every so many words are replaced."""
        key = F.col("c_custkey")
        every = F.when(key % 4 == 0, F.lit(10**9)).otherwise(12 + (key * 37) % 150)
        signed = F.replace("text", F.lit("<owner>"), F.col("c_name"))
        words = F.transform(F.split(signed, " "), lambda w, i: F.when((i + key) % every == every - 1, F.lower("c_mktsegment")).otherwise(w))
        texts = self.spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS.values())], "kind int, text string")
        return (
            self.table("customer").withColumn("kind", (key % len(TEXTS)).cast("int")).join(texts, "kind")
            .select(text("c_custkey").alias("repo"), F.lit("LICENSE").alias("path"), F.array_join(words, " ").cast("binary").alias("content"))
        )

    def failures(self) -> DataFrame:
        """Some repositories whose files, commits or history could not be had."""
        key = F.col("c_custkey")
        stages = F.array_compact(
            F.array(
                F.when(key % 29 == 0, F.lit("files")),
                F.when(key % 31 == 0, F.lit("health")),
                F.when(key % 37 == 0, F.lit("ai-estimate")),
            )
        )
        return self.table("customer").select(
            text("c_custkey").alias("repo"),
            F.explode(stages).alias("stage"),
            F.concat(F.lit("status "), (F.lit(400) + key % 100).cast("string")).alias("error"),
        )

    def portfolio(self) -> Portfolio:
        license_files = self.license_files().withColumn("commit_hash", F.lit(None).cast("string"))
        return Portfolio(
            repos=self.repos(), files=self.head_files().unionByName(license_files), license_corpus=self.corpus(), commits=self.commits(), commit_stats=self.commit_stats(),
            commit_files=self.commit_files(), failures=self.failures(),
        )

    # Landed pages of each provider, a page per hundred keys.

    def _repo_pages(self, element: Column, wrap: bool) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        page = F.floor(F.col("c_custkey") / 100)
        items = F.collect_list(element)
        value = F.struct(items.alias("values"), F.lit("").alias("next")) if wrap else items
        return (
            self.table("customer").join(nation, "c_nationkey").groupBy(page.alias("page")).agg(F.to_json(value).alias("value"))
        )

    def github_repo_pages(self) -> DataFrame:
        url = F.concat(F.lit("https://gh.example/"), "n_name", F.lit("/"), "c_name")
        return self._repo_pages(
            F.struct(
                F.col("c_name").alias("name"),
                F.concat("n_name", F.lit("/"), "c_name").alias("full_name"),
                url.alias("html_url"),
                F.concat(url, F.lit(".git")).alias("clone_url"),
                (F.col("c_acctbal") < 0).alias("archived"),
                (F.col("c_custkey") % 10 == 0).alias("fork"),
            ),
            wrap=False,
        )

    def gitlab_repo_pages(self) -> DataFrame:
        namespace = F.concat("n_name", F.lit("/"), "c_mktsegment")
        url = F.concat(F.lit("https://gl.example/"), namespace, F.lit("/"), "c_name")
        fork = F.when(F.col("c_custkey") % 10 == 0, F.struct(F.lit(1).alias("id")))
        return self._repo_pages(
            F.struct(
                F.col("c_custkey").alias("id"),
                F.lower("c_name").alias("path"),
                F.col("c_name").alias("name"),
                url.alias("web_url"),
                F.concat(url, F.lit(".git")).alias("http_url_to_repo"),
                F.lit("trunk").alias("default_branch"),
                (F.col("c_acctbal") < 0).alias("archived"),
                fork.alias("forked_from_project"),
                F.struct(namespace.alias("full_path")).alias("namespace"),
            ),
            wrap=False,
        )

    def bitbucket_repo_pages(self) -> DataFrame:
        full = F.concat("n_name", F.lit("/"), "c_name")
        url = F.concat(F.lit("https://bb.example/"), full)
        branch = F.when(F.col("c_custkey") % 4 == 0, F.struct(F.lit("dev line").alias("name")))
        parent = F.when(F.col("c_custkey") % 10 == 0, F.struct(F.lit("up/stream").alias("full_name")))
        links = F.array(
            F.struct(F.lit("ssh").alias("name"), F.concat(F.lit("git@"), full).alias("href")),
            F.struct(F.lit("https").alias("name"), F.concat(url, F.lit(".git")).alias("href")),
        )
        element = F.to_json(
            F.struct(
                F.col("c_name").alias("slug"),
                full.alias("full_name"),
                F.struct(F.col("c_mktsegment").alias("key")).alias("project"),
                branch.alias("mainbranch"),
                F.struct(F.struct(url.alias("href")).alias("html"), links.alias("clone")).alias("links"),
                parent.alias("parent"),
            )
        )
        # Every 50th element is not a repository.
        broken = F.when(F.col("c_custkey") % 50 == 0, F.lit('"broken"')).otherwise(element)
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        value = F.concat(F.lit('{"values": ['), F.array_join(F.collect_list(broken), ", "), F.lit('], "next": ""}'))
        page = F.floor(F.col("c_custkey") / 100)
        return self.table("customer").join(nation, "c_nationkey").groupBy(page.alias("page")).agg(value.alias("value"))

    def project_pages(self) -> DataFrame:
        element = F.struct(F.upper("n_name").alias("key"), F.col("n_name").alias("name"))
        value = F.to_json(F.struct(F.collect_list(element).alias("values")))
        return self.table("nation").groupBy(F.col("n_regionkey").alias("page")).agg(value.alias("value"))

    def subgroup_pages(self) -> DataFrame:
        region = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        element = F.struct(
            F.col("n_nationkey").alias("id"),
            F.lower("n_name").alias("path"),
            F.concat("r_name", F.lit("/"), F.lower("n_name")).alias("full_path"),
            F.col("n_name").alias("name"),
        )
        joined = self.table("nation").join(region, "n_regionkey")
        return joined.groupBy(F.col("n_regionkey").alias("page")).agg(F.to_json(F.collect_list(element)).alias("value"))

    def commit_pages(self, provider: str) -> DataFrame:
        name = F.concat(F.lit("Dev "), (F.col("o_orderkey") % 3).cast("string"))
        email = F.concat(F.lit("dev"), (F.col("o_orderkey") % 3).cast("string"), F.lit("@e.com"))
        # Every 17th date cannot be read.
        date = F.when(F.col("o_orderkey") % 17 == 0, F.lit("soon")).otherwise(
            F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        )
        message = F.concat(F.lit("Change\n"), "o_orderpriority")

        def moved(sign: int) -> Column:
            """The other clock."""
            days = F.make_dt_interval((F.col("o_orderkey") % 5 * 40 * sign).cast("int"))
            return F.when(F.col("o_orderkey") % 17 > 0, F.date_format(F.col("o_orderdate").cast("timestamp") + days, "yyyy-MM-dd'T'HH:mm:ss'Z'"))

        if provider == "github":
            author = F.struct(name.alias("name"), email.alias("email"), date.alias("date"))
            element = F.struct(
                text("o_orderkey").alias("sha"), F.struct(author.alias("author"), F.struct(moved(1).alias("date")).alias("committer"), message.alias("message")).alias("commit")
            )
        elif provider == "gitlab":
            element = F.struct(
                text("o_orderkey").alias("id"), name.alias("author_name"), email.alias("author_email"),
                message.alias("message"), date.alias("committed_date"), moved(-1).alias("authored_date"),
            )
        else:
            raw = F.struct(F.concat(name, F.lit(" <"), email, F.lit(">")).alias("raw"))
            element = F.struct(
                text("o_orderkey").alias("hash"), date.alias("date"), message.alias("message"), raw.alias("author")
            )
        items = F.collect_list(element)
        value = F.struct(items.alias("values")) if provider == "bitbucket" else items
        page = F.floor(F.col("o_orderkey") / 100)
        return (
            self.table("orders")
            .groupBy(text("o_custkey").alias("repo"), page.alias("page"))
            .agg(F.to_json(value).alias("value"))
        )

    def detail_pages(self) -> DataFrame:
        changed = F.struct(F.col("path").alias("filename"), "additions", "deletions")
        stats = F.struct(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
        value = F.struct(stats.alias("stats"), F.collect_list(changed).alias("files"))
        return self.commit_files().groupBy("repo", "hash").agg(F.to_json(value).alias("value")).withColumn("page", F.lit(1))

    def diff_pages(self) -> DataFrame:
        """Two pages per commit; odd lines are deleted files, which only have an old path."""
        path = F.struct("path")
        odd = F.col("deletions") % 2 == 1
        element = F.struct(
            F.when(~odd, path).alias("new"),
            F.struct(F.concat(F.lit("old-"), "path").alias("path")).alias("old"),
            F.col("additions").alias("lines_added"),
            F.col("deletions").alias("lines_removed"),
        )
        value = F.to_json(F.struct(F.collect_list(element).alias("values")))
        page = (F.col("deletions") % 2).alias("page")
        return self.commit_files().groupBy("repo", "hash", page).agg(value.alias("value"))

    def archives(self) -> DataFrame:
        """An archive per document, wrapped in a folder, with one file that tries to leave it."""
        docs = self.table("documents").select(F.concat(F.lit("doc"), text("doc_id")).alias("repo"), "text")
        # Packing costs far more than moving the text, and the small tables are one row group each.
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return docs.repartition(partitions, "repo").mapInPandas(_pack, "repo string, commit_hash string, content binary")

    def report_texts(self) -> DataFrame:
        """Reports of both kinds, one per hundred customers."""
        block = F.floor(F.col("c_custkey") / 100)
        code = F.floor(F.abs("c_acctbal")).cast("bigint")
        repository = F.struct(F.col("c_name").alias("repository"), F.struct(code.alias("code")).alias("totals"))
        snapshot = F.struct(F.col("c_name").alias("period"), F.struct(code.alias("code")).alias("totals"))
        grouped = self.table("customer").groupBy(block.alias("block")).agg(
            F.collect_list(repository).alias("repositories"), F.collect_list(snapshot).alias("snapshots")
        )
        organization = F.concat(F.lit("org"), text("block")).alias("organization")
        standard = F.to_json(F.struct(organization, "repositories"))
        trends = F.to_json(F.struct(organization, "snapshots"))
        return grouped.select(F.when(F.col("block") % 2 == 0, standard).otherwise(trends).alias("value"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, body in zip(batch.repo, batch.text.str.encode("utf-8")):
            packed = io.BytesIO()
            with tarfile.open(fileobj=packed, mode="w:gz", compresslevel=1) as archive:
                for name, content in (("top-1/src/main.txt", body), ("top-1/../../evil.txt", b"evil")):
                    member = tarfile.TarInfo(name)
                    member.size = len(content)
                    archive.addfile(member, io.BytesIO(content))
            rows.append((repo, None, packed.getvalue()))
        yield pd.DataFrame(rows, columns=["repo", "commit_hash", "content"])
