"""Endings of files whose extension leads to several languages."""

# (extension, text put after the document)
CASES = [
    (".h", "int x;"),
    (".h", "namespace a { class B { public: std::string c; }; }"),
    (".h", "#import <F/F.h>\n@interface A\n@property int b;\n@end"),
    (".h", "struct classy { int using; };"),
    (".m", "x = zeros(3);\nend\n"),
    (".m", "@implementation A\n@end"),
    (".m", ""),
    (".pl", "use strict;\nmy $x = 1;\nsub f { $_ =~ /a/ }"),
    (".pl", "parent(a, b).\nolder(X, Y) :- parent(X, Y), \\\\+ atom(X).\n?- older(a, B)."),
    (".pl", "?"),
    (".r", "x <- c(1, 2)\nlibrary(stats)"),
    (".r", "REBOL [Title: 1]\nf: func [x] [print [x]]"),
    (".ts", "export const x: number = 1"),
    (".ts", "<!DOCTYPE TS><TS version='2.1'><context><translation>a</translation></context></TS>"),
    (".ts", "<TS "),
]
