"""Path and content rules for vendored, generated and version-control files."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Rules of third-party code, each a pattern of whole paths; after the public list of vendored paths that code hosts use to leave
# such files out of statistics (GitHub Linguist, MIT license). A rule that ends in a slash is about directories, everything below which is dropped;
# any other is about single files. Declarations of TypeScript, which that list has too, are counted here as a language of their own.
VENDORED = [
    r"(^|/)cache/",
    r"^[Dd]ependencies/",
    r"(^|/)dist/",
    r"^deps/",
    r"(^|/)configure$",
    r"(^|/)config\.guess$",
    r"(^|/)config\.sub$",
    r"(^|/)aclocal\.m4$",
    r"(^|/)libtool\.m4$",
    r"(^|/)ltoptions\.m4$",
    r"(^|/)ltsugar\.m4$",
    r"(^|/)ltversion\.m4$",
    r"(^|/)lt~obsolete\.m4$",
    r"(^|/)dotnet-install\.ps1$",
    r"(^|/)dotnet-install\.sh$",
    r"(^|/)cpplint\.py$",
    r"(^|/)node_modules/",
    r"(^|/)\.yarn/",
    r"(^|/)_esy$",
    r"(^|/)bower_components/",
    r"^rebar$",
    r"(^|/)erlang\.mk$",
    r"(^|/)[Gg]odeps/_workspace/",
    r"(^|/)testdata/",
    r"(^|/)tests?/fixtures/",
    r"(^|/)specs?/fixtures/",
    r"(^|/)\.indent\.pro$",
    r"[.-]min\.(js|css)$",
    r"[^\s/]*import\.(css|less|scss|styl)$",
    r"(^|/)bootstrap([^/.]*)(\.[^/]*)?\.(js|css|less|scss|styl)$",
    r"(^|/)custom\.bootstrap([^\s/]*)(css|less|scss|styl)$",
    r"(^|/)font-?awesome\.(css|less|scss|styl)$",
    r"(^|/)font-?awesome/.*\.(css|less|scss|styl)$",
    r"(^|/)foundation\.(css|less|scss|styl)$",
    r"(^|/)normalize\.(css|less|scss|styl)$",
    r"(^|/)skeleton\.(css|less|scss|styl)$",
    r"(^|/)[Bb]ourbon/.*\.(css|less|scss|styl)$",
    r"(^|/)animate\.(css|less|scss|styl)$",
    r"(^|/)materialize\.(css|less|scss|styl|js)$",
    r"(^|/)select2/.*\.(css|scss|js)$",
    r"(^|/)bulma\.(css|sass|scss)$",
    r"(3rd|[Tt]hird)[-_]?[Pp]arty/",
    r"(^|/)vendors?/",
    r"(^|/)[Ee]xtern(als?)?/",
    r"(^|/)[Vv]+endor/",
    r"^debian/",
    r"(^|/)run\.n$",
    r"(^|/)bootstrap-datepicker/",
    r"(^|/)jquery([^./]*)\.js$",
    r"(^|/)jquery-\d\.\d+(\.\d+)?\.js$",
    r"(^|/)jquery-ui(-\d\.\d+(\.\d+)?)?(\.\w+)?\.(js|css)$",
    r"(^|/)jquery\.(ui|effects)\.([^./]*)\.(js|css)$",
    r"(^|/)jquery\.fn\.gantt\.js$",
    r"(^|/)jquery\.fancybox\.(js|css)$",
    r"(^|/)fuelux\.js$",
    r"(^|/)jquery\.fileupload(-\w+)?\.js$",
    r"(^|/)jquery\.dataTables\.js$",
    r"(^|/)bootbox\.js$",
    r"(^|/)pdf\.worker\.js$",
    r"(^|/)slick\.\w+\.js$",
    r"(^|/)[Ll]eaflet\.Coordinates-\d+\.\d+\.\d+\.src\.js$",
    r"(^|/)leaflet\.draw-src\.js$",
    r"(^|/)leaflet\.draw\.css$",
    r"(^|/)Control\.FullScreen\.css$",
    r"(^|/)Control\.FullScreen\.js$",
    r"(^|/)leaflet\.spin\.js$",
    r"(^|/)wicket-leaflet\.js$",
    r"(^|/)\.sublime-project$",
    r"(^|/)\.sublime-workspace$",
    r"(^|/)\.vscode/",
    r"(^|/)prototype([^/]*)\.js$",
    r"(^|/)effects\.js$",
    r"(^|/)controls\.js$",
    r"(^|/)dragdrop\.js$",
    r"(^|/)mootools([^./]*)\d+\.\d+.\d+([^./]*)\.js$",
    r"(^|/)dojo\.js$",
    r"(^|/)MochiKit\.js$",
    r"(^|/)yahoo-([^./]*)\.js$",
    r"(^|/)yui([^./]*)\.js$",
    r"(^|/)ckeditor\.js$",
    r"(^|/)tiny_mce([^./]*)\.js$",
    r"(^|/)tiny_mce/(langs|plugins|themes|utils)/",
    r"(^|/)ace-builds/",
    r"(^|/)fontello([^/]*)\.css$",
    r"(^|/)MathJax/",
    r"(^|/)Chart\.js$",
    r"(^|/)[Cc]ode[Mm]irror/(\d+\.\d+/)?(lib|mode|theme|addon|keymap|demo)/",
    r"(^|/)shBrush([^./]*)\.js$",
    r"(^|/)shCore\.js$",
    r"(^|/)shLegacy\.js$",
    r"(^|/)angular([^./]*)\.js$",
    r"(^|/)d3(\.v\d+)?([^./]*)\.js$",
    r"(^|/)react(-[^./]*)?\.js$",
    r"(^|/)flow-typed/.*\.js$",
    r"(^|/)modernizr-\d\.\d+(\.\d+)?\.js$",
    r"(^|/)modernizr\.custom\.\d+\.js$",
    r"(^|/)knockout-(\d+\.){3}(debug\.)?js$",
    r"(^|/)docs?/_?(build|themes?|templates?|static)/",
    r"(^|/)admin_media/",
    r"(^|/)env/",
    r"(^|/)fabfile\.py$",
    r"(^|/)waf$",
    r"(^|/)\.osx$",
    r"\.xctemplate/",
    r"\.imageset/",
    r"(^|/)Carthage/",
    r"(^|/)Pods/",
    r"(^|/)Sparkle/",
    r"(^|/)Crashlytics\.framework/",
    r"(^|/)Fabric\.framework/",
    r"(^|/)BuddyBuildSDK\.framework/",
    r"(^|/)Realm\.framework/",
    r"(^|/)RealmSwift\.framework/",
    r"(^|/)\.gitattributes$",
    r"(^|/)\.gitignore$",
    r"(^|/)\.gitmodules$",
    r"(^|/)gradlew$",
    r"(^|/)gradlew\.bat$",
    r"(^|/)gradle/wrapper/",
    r"(^|/)mvnw$",
    r"(^|/)mvnw\.cmd$",
    r"(^|/)\.mvn/wrapper/",
    r"-vsdoc\.js$",
    r"\.intellisense\.js$",
    r"(^|/)jquery([^./]*)\.validate(\.unobtrusive)?\.js$",
    r"(^|/)jquery([^./]*)\.unobtrusive-ajax\.js$",
    r"(^|/)[Mm]icrosoft([Mm]vc)?([Aa]jax|[Vv]alidation)(\.debug)?\.js$",
    r"(^|/)[Pp]ackages/.+\.\d+/",
    r"(^|/)extjs/.*\.js$",
    r"(^|/)extjs/.*\.css$",
    r"(^|/)cordova([^./]*)\.js$",
    r"(^|/)cordova-\d\.\d(\.\d)?\.js$",
    r"(^|/)foundation(\.[^/]*)?\.js$",
    r"(^|/)Vagrantfile$",
    r"(^|/)\.DS_Store$",
    r"(^|/)inst/extdata/",
    r"(^|/)octicons\.css$",
    r"(^|/)sprockets-octicons\.scss$",
    r"(^|/)activator$",
    r"(^|/)activator\.bat$",
    r"(^|/)proguard\.pro$",
    r"(^|/)proguard-rules\.pro$",
    r"(^|/)puphpet/",
    r"(^|/)\.google_apis/",
    r"^Jenkinsfile$",
    r"(^|/)\.gitpod\.Dockerfile$",
    r"(^|/)\.github/",
    r"(^|/)\.obsidian/",
    r"(^|/)\.teamcity/",
    r"(^|/)[Ss]ourcemaps?/",
]
# Directories of version-control systems.
VERSION_CONTROL = [r"(^|/)\.git/", r"(^|/)\.hg/"]

# Names of files that tools write, their endings, and a directory of such files.
GENERATED_NAMES = [
    r"(?:Gopkg|glide|Cargo|poetry|composer|Pipfile|mix|Podfile)\.lock",
    r"(?:package-lock|npm-shrinkwrap)\.json",
    r"pnpm-lock\.yaml",
    r"yarn\.lock",
    r"go\.sum",
]
GENERATED_ENDINGS = [
    r"\.pb\.(?:go|cc|h)",
    r"_pb2(?:_grpc)?\.py",
    r"\.designer\.(?:cs|vb)",
    r"\.(?:nib|xcworkspacedata|xcuserstate)",
    r"\.(?:js|css)\.map",
]
GENERATED_DIRECTORY = "__generated__"

# Markers of generated code, whole words.
GENERATED_MARKERS = [
    "Code generated",
    "@generated",
    "DO NOT EDIT",
    "Generated by the protocol buffer compiler",
    "Autogenerated by Thrift Compiler",
    "This file was automatically generated",
    "GENERATED CODE",
]

# What most markers contain, so that these searches spare nearly all files those for each. They start with letters that are rare in texts.
GENERATED_STEMS = ("generated", "Generated")

# Scripts and style sheets whose lines are longer than this on average were minified.
MINIFIED_EXTENSION = r"\.(?:js|css)$"
MINIFIED_LINE_LENGTH = 110

# Fixed value: files in the root of a repository that may hold its license.
LICENSE_FILE = r"(?i)^(?:un)?(?:licen[cs]e|copying|copyright)[^/]*$"


def _one(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


GENERATED_PATH = "|".join(
    [f"(?:^|/){_one(GENERATED_NAMES)}$", f"{_one(GENERATED_ENDINGS)}$", f"(?:^|/){GENERATED_DIRECTORY}/"]
)
GENERATED_MARK = rf"(?<!\w){_one(GENERATED_MARKERS)}(?!\w)"


@dataclass(frozen=True)
class PathIndex:
    """Rules by what a path can be looked up for: whole names of directories and files, and the extension; few are left to be searched for."""

    directories: frozenset[str]  # any segment of the directory
    root_directories: frozenset[str]  # the first one
    names: frozenset[str]
    root_names: frozenset[str]
    by_extension: dict[str, str]  # extension -> pattern of the paths
    other_directories: str  # pattern of directories that are told by more than one segment or by the end of one
    other_files: str
    folder_search: str  # other_directories with the common start tried once a place


_START, _LITERAL = r"(^|/)", re.compile(r"(?:[\w~ -]|\\\.)+")


def _spelled_out(rule: str) -> list[str]:
    """A rule with one optional plural s, or a first letter of either case, as the rules that it stands for."""
    plural = re.fullmatch(r"(.*[a-z])s\?(/|\$)", rule)
    if plural:
        return [x for stem in (plural[1], plural[1] + "s") for x in _spelled_out(stem + plural[2])]
    cased = re.search(r"\[([A-Z])([a-z])\](?!\+)", rule)
    if cased:
        return [x for letter in cased.groups() for x in _spelled_out(rule[: cased.start()] + letter + rule[cased.end() :])]
    return [rule]


def _search(rules: list[str]) -> str:
    """One pattern for all rules; those that start a segment share that start, so at most places of a path only it is tried."""
    begun = [rule.removeprefix(_START) for rule in rules if rule.startswith(_START)]
    shared = [f"(?:^|/){_one(begun)}"] if begun else []
    return "|".join([*shared, *[rule for rule in rules if not rule.startswith(_START)]])


def path_index(rules: list[str]) -> PathIndex:
    """Take rules to the keys they can be looked up by; every rule ends up in exactly one place."""
    sets: dict[str, set[str]] = {"directories": set(), "root_directories": set(), "names": set(), "root_names": set()}
    by_extension: dict[str, list[str]] = {}
    others: dict[str, list[str]] = {"directories": [], "files": []}
    for rule in rules:
        about = "directories" if rule.endswith("/") else "names"
        start = _START if rule.startswith(_START) else "^" if rule.startswith("^") else ""
        bodies = [x[len(start) :].removesuffix("/").removesuffix("$") for x in _spelled_out(rule)]
        extensions = re.search(r"\\\.(?:(\w+)|\(([\w|]+)\))\$$", rule)
        if start and all(_LITERAL.fullmatch(body) for body in bodies):
            sets[about if start == _START else f"root_{about}"].update(body.replace("\\", "") for body in bodies)
        elif about == "directories":
            others["directories"].append(rule)
        elif extensions:
            for extension in (extensions[1] or extensions[2]).split("|"):
                by_extension.setdefault(extension, []).append(rule)
        else:
            others["files"].append(rule)
    return PathIndex(
        **{name: frozenset(keys) for name, keys in sets.items()},
        by_extension={extension: "|".join(found) for extension, found in sorted(by_extension.items())},
        other_directories="|".join(others["directories"]), other_files="|".join(others["files"]), folder_search=_search(others["directories"]),
    )


PRUNED_INDEX = path_index([rule for rule in [*VERSION_CONTROL, *VENDORED] if rule.endswith("/")])
VENDOR_INDEX = path_index([rule for rule in VENDORED if not rule.endswith("/")])


def _directory_search(rules: PathIndex) -> str:
    """One pattern of paths for all rules of an index about directories; what it finds ends in a slash, so the name of a file is never part of it.

    A segment is compared with the names only if one of them starts as it does.
    """

    def names(directories: frozenset[str]) -> str:
        starts = "".join(sorted({re.escape(name[0]) for name in directories}))
        return f"(?=[{starts}]){_one(sorted(re.escape(name) for name in directories))}/"

    return f"(?:^|/){names(rules.directories)}|^{names(rules.root_directories)}|{rules.folder_search}"


PRUNED_SEARCH = _directory_search(PRUNED_INDEX)
