"""Path rules looked up by an index, against every rule tried on every path."""

import os
import re

from pyspark.sql import functions as F

from checks.ruled_paths import CASES
from tallyforge.operators import codestats
from tallyforge.rules import paths as P
from tallyforge.session import drop_staged, shared_folder, stage


def samples() -> list[str]:
    names = ["a.py", "configure", "Configure", "jquery.js", "jquery-1.2.js", "jquery.ui.x.css", "x-vsdoc.js", "app.min.js", "appmin.js", "rebar", "Jenkinsfile", "d3.v4.js", "Chart.js", "chart.js",
             "yui-x.js", "run.n", "runxn", "custom.bootstrap.css", "custom.bootstrapcss", "knockout-1.2.3.js", "knockout-1.2.3.debug.js", "bootstrap.min.css", "import.scss", "microsoftAjax.js", "gradlew.bat", "a", "", ".DS_Store"]
    folders = ["", "src/", "deps/", "src/deps/", "Dependencies/x/", "cache/", "xcache/", "a/vendors/b/", "a/Vvendor/", "tests/fixtures/", "test/fixtures/x/", "fixtures/", "my3rd-Party/", "docs/_static/", "docs/static2/",
               "a.imageset/", "Packages/x.1.2/", "packages/x/", "tiny_mce/langs/", "tiny_mce/lang/", ".git/", "x/.git/y/", ".github/", "CodeMirror/5.1/mode/", "extern/", "externs/", "font-awesome/x/", "bourbon/", "select2/", "extjs/"]
    return [folder + name for folder in folders for name in names] + [path for path, _, _ in CASES]


def test_index_equals_all_rules(spark):
    pruned = [re.compile(rule) for rule in [*P.VERSION_CONTROL, *P.VENDORED] if rule.endswith("/")]
    vendored = [re.compile(rule) for rule in P.VENDORED if not rule.endswith("/")]
    df = spark.createDataFrame([(p,) for p in samples()], "path string")
    got = df.select("path", codestats.in_pruned_directory(F.col("path")).alias("pruned"), codestats.is_vendored(F.col("path")).alias("vendored")).collect()
    for row in got:
        folder = row.path[: row.path.rfind("/") + 1]
        assert row.pruned == any(rule.search(folder) for rule in pruned), row.path
        assert row.vendored == any(rule.search(row.path) for rule in vendored), row.path
    assert 100 < sum(r.pruned for r in got) < len(got) - 100 and sum(r.vendored for r in got) > 100


def test_every_rule_has_one_place():
    for rules in ([r for r in [*P.VERSION_CONTROL, *P.VENDORED] if r.endswith("/")], [r for r in P.VENDORED if not r.endswith("/")]):
        index = P.path_index(rules)
        patterns = "|".join([index.other_directories, index.other_files, *index.by_extension.values()])
        exact = index.directories | index.root_directories | index.names | index.root_names
        for rule in rules:
            held = [re.sub(r"^\(\^\|/\)|^\^|[/$]$", "", x).replace("\\", "") for x in P._spelled_out(rule)]
            assert rule in patterns or all(x in exact for x in held), rule


def test_staged_tables_go_when_told(spark):
    drop_staged(spark)
    one = stage(spark.range(5), "here")
    assert one.count() == 5
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    assert drop_staged(spark) == 1 and drop_staged(spark) == 0
    assert before - set(os.listdir(folder)) == {next(x for x in before if x.startswith("here-"))}
