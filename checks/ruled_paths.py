"""Paths that the rules of file classes speak of, what is added to the text of the file, and what becomes of it."""

# (path, added text, status; None where the file is not looked at)
CASES = [
    (".git/hooks/commit.py", "", None),
    ("sub/.hg/store.py", "", None),
    ("sub/git/store.py", "", "counted"),
    ("deps/lib.py", "", None),
    ("src/deps/lib.py", "", "counted"),
    ("Dependencies/lib.go", "", None),
    ("old/third-party/lib.go", "", None),
    ("old3rdParty/lib.go", "", None),
    ("a/b/node_modules/c/d.py", "", None),
    ("node_modules2/c.py", "", "counted"),
    ("docs/_build/conf.py", "", None),
    ("docs/building/conf.py", "", "counted"),
    ("web/externals/a.py", "", None),
    ("web/external/a.py", "", None),
    ("web/externalized/a.py", "", "counted"),
    ("ui/App.xctemplate/a.py", "", None),
    ("ui/codemirror/lib/a.py", "", None),
    ("lib/jquery-3.6.0.js", "", "filtered"),
    ("lib/jqueryish/own.py", "", "counted"),
    ("lib/site.min.css", "", "filtered"),
    ("lib/my-bootstrap.py", "", "counted"),
    ("css/font-awesome/all.css", "", "filtered"),
    ("css/fontawesome.scss", "", "filtered"),
    ("tools/configure", "", "filtered"),
    ("tools/configure.py", "", "counted"),
    ("rebar", "", "filtered"),
    ("sub/rebar", "", "unknown"),
    ("Jenkinsfile", "", "filtered"),
    ("knockout-3.5.1.js", "", "filtered"),
    ("x/knockout-3.5.1.debug.js", "", "filtered"),
    ("gradle/wrapper/run.py", "", None),
    ("gradlew", "", "filtered"),
    ("api/service.pb.go", "", "filtered"),
    ("api/late.py", "\n# Code generated by a tool\n", "filtered"),
    ("api/later.zzz", "\n@generated", "filtered"),
    ("api/degenerate.py", "\n# Uncode generatedness\n", "counted"),
    ("data/nul.py", "\x00", "binary"),
    ("data/nul.zzz", "\x00", "unknown"),
    ("data/plain", "", "unknown"),
]
