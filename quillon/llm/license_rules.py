"""Signatures of licenses, over normalised text: words in lower case with single spaces.

A family gives a label, keywords (apart by |) of which each of its texts contains one, SPDX ids, the words of its name and of its addresses. Every
family is spelled out by TEMPLATES into rules, in order of priority: identifier tags, grants and addresses, titles,
mentions. OTHER holds rules that stand alone, NOTICES sentences of full notices, versions in other word orders, exceptions
and terms of use. NEGATED is a grant that is denied: it hides the grant it contains, and is neither a license nor a score. A space in a rule is one word boundary; ANY is one word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

ANY = r"[^ ~]+"
L = r"licen[sc]e"
NOTICE = rf"(?:licensed|released|distributed|available|provided|published|shared|offered|made available|redistributed|covered) (?:{ANY} )?(?:under|by) (?:(?:the|a|an) )?(?:(?:terms|conditions) (?:and conditions )?of (?:the )?)?"


def _v(major: str, minor: str = "0") -> str:
    return rf"(?:v(?:ersion)?(?: |)?{major}(?: {minor})?|{major} {minor})"


@dataclass(frozen=True)
class Family:
    label: str
    keyword: str
    ids: str  # of SPDX, as words, alternatives apart by |
    name: str
    address: str = ""


def _gnu(kind: str, label: str, keyword: str, words: str, versions: tuple[tuple[str, str], ...]) -> list[Family]:
    out = []
    for major, minor in versions:
        v = major if minor == "0" else f"{major}.{minor}"
        out.append(
            Family(
                f"{label}-{major}.{minor}", keyword, rf"{kind} {major} {minor}(?: only| or later)?|{kind} ?v?{v[:1]}",
                rf"(?:gnu )?(?:{words}|{kind})(?: as published by the free software foundation)?(?: either)?(?: {kind})? {_v(major, minor)}(?: or (?:any )?later(?: version)?)?|{kind}v{major}(?: {minor})?",
                rf"gnu org licenses (?:old licenses )?{kind} {major} {minor}",
            )
        )
    return out


def _cc(code: str, words: str) -> list[Family]:
    out = []
    for major, minor in (("1", "0"), ("2", "0"), ("2", "5"), ("3", "0"), ("4", "0")):
        out.append(
            Family(
                f"cc-{code.replace(' ', '-')}-{major}.{minor}", " cc~|commons", rf"cc {code} {major} {minor}",
                rf"(?:cc {code}|creative commons {words}(?: public licen[sc]e)?) {_v(major, minor)}(?: (?:international|unported|generic))?",
                rf"creativecommons org licenses {code.replace(' ', ' ')} {major} {minor}",
            )
        )
    return out


FAMILIES: list[Family] = [
    Family("mit", " mit~|expat|x11", "mit", rf"mit {L}|expat {L}|x11 {L}", "opensource org licenses? mit"),
    Family("mit-0", " mit~", "mit 0", rf"mit no attribution(?: {L})?"),
    Family("apache-1.1", "apache", "apache 1 1", rf"apache (?:software )?{L} {_v('1', '1')}", "apache org licenses license 1 1"),
    Family("apache-2.0", "apache| asl~", "apache 2 0", rf"apache (?:software )?(?:{L} )?{_v('2')}|asl 2 0", "apache org licenses license 2 0"),
    *_gnu("gpl", "gpl", "general|gpl", "general public licen[sc]e", (("1", "0"), ("2", "0"), ("3", "0"))),
    *_gnu("lgpl", "lgpl", "general|lgpl", "(?:lesser|library) general public licen[sc]e", (("2", "0"), ("2", "1"), ("3", "0"))),
    *_gnu("agpl", "agpl", "affero|agpl", "affero general public licen[sc]e", (("1", "0"), ("3", "0"))),
    *_gnu("gfdl", "gfdl", "documentation|gfdl", "free documentation licen[sc]e", (("1", "1"), ("1", "2"), ("1", "3"))),
    *_cc("by", "attribution"),
    *_cc("by sa", "attribution share ?alike"),
    *_cc("by nc", "attribution non ?commercial"),
    *_cc("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    *_cc("by nc sa", "attribution non ?commercial share ?alike"),
    *_cc("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    Family("cc0-1.0", "cc0|zero", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", "creativecommons org publicdomain zero 1 0"),
    Family("cc-pdm-1.0", "domain", "cc pdm 1 0", r"public domain mark(?: 1 0)?", "creativecommons org publicdomain mark 1 0"),
    Family("bsd-0-clause", "bsd", "0bsd", rf"(?:0|zero) ?clause bsd(?: {L})?"),
    Family("bsd-1-clause", "bsd", "bsd 1 clause", rf"(?:1|one) ?clause bsd(?: {L})?"),
    Family("bsd-2-clause", "bsd", "bsd 2 clause", rf"(?:(?:2|two) ?clause|simplified|freebsd) bsd(?: {L})?|freebsd {L}", "opensource org licenses? bsd 2 clause"),
    Family("bsd-3-clause", "bsd", "bsd 3 clause", rf"(?:(?:3|three) ?clause|new|modified|revised) bsd(?: {L})?", "opensource org licenses? bsd 3 clause"),
    Family("bsd-4-clause", "bsd", "bsd 4 clause", rf"(?:(?:4|four) ?clause|original|old) bsd(?: {L})?"),
    Family("mpl-1.0", "mozilla| mpl~", "mpl 1 0", rf"(?:mozilla public {L}|mpl) {_v('1')}"),
    Family("mpl-1.1", "mozilla| mpl~", "mpl 1 1", rf"(?:mozilla public {L}|mpl) {_v('1', '1')}", "mozilla org mpl mpl 1 1"),
    Family("mpl-2.0", "mozilla| mpl~", "mpl 2 0", rf"(?:mozilla public {L}|mpl) {_v('2')}", "mozilla org mpl 2 0"),
    Family("epl-1.0", "eclipse| epl~", "epl 1 0", rf"(?:eclipse public {L}|epl) {_v('1')}", "eclipse org legal epl v10"),
    Family("epl-2.0", "eclipse| epl~", "epl 2 0", rf"(?:eclipse public {L}|epl) {_v('2')}", "eclipse org legal epl 2 0"),
    Family("edl-1.0", "eclipse| edl~", "edl 1 0", rf"eclipse distribution {L}(?: {_v('1')})?", "eclipse org org documents edl v10"),
    Family("eupl-1.1", "european| eupl~", "eupl 1 1", rf"(?:european union public {L}|eupl) {_v('1', '1')}"),
    Family("eupl-1.2", "european| eupl~", "eupl 1 2", rf"(?:european union public {L}|eupl) {_v('1', '2')}"),
    Family("cddl-1.0", "development| cddl~", "cddl 1 0", rf"(?:common development and distribution {L}|cddl) {_v('1')}"),
    Family("cddl-1.1", "development| cddl~", "cddl 1 1", rf"(?:common development and distribution {L}|cddl) {_v('1', '1')}"),
    Family("cpl-1.0", " common~| cpl~", "cpl 1 0", rf"common public {L}(?: {_v('1')})?"),
    Family("cpal-1.0", " common~| cpal~", "cpal 1 0", rf"common public attribution {L}(?: {_v('1')})?"),
    Family("artistic-1.0", "artistic", "artistic 1 0", rf"artistic {L} {_v('1')}"),
    Family("artistic-2.0", "artistic", "artistic 2 0", rf"artistic {L} {_v('2')}"),
    Family("isc", " isc~", "isc", rf"isc {L}", "opensource org licenses? isc"),
    Family("zlib", "zlib", "zlib", rf"zlib(?: libpng)? {L}"),
    Family("libpng", "libpng", "libpng 2 0|libpng", rf"libpng {L}"),
    Family("bsl-1.0", "boost| bsl~", "bsl 1 0", rf"boost software {L}(?: {_v('1')})?", "boost org license 1 0"),
    Family("busl-1.1", "business|busl", "busl 1 1", rf"business source {L}(?: {_v('1', '1')})?"),
    Family("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense", "unlicense org"),
    Family("wtfpl", "wtfpl|want", "wtfpl", rf"wtfpl|do what the (?:fuck|f) you want to public {L}"),
    Family("psf-2.0", "python| psf~", "psf 2 0|python 2 0", rf"python software foundation {L}(?: {_v('2')})?|psf {L}"),
    Family("ofl-1.1", " font~| ofl~", "ofl 1 1", rf"(?:sil )?open font {L}(?: {_v('1', '1')})?", "scripts sil org ofl"),
    Family("odbl-1.0", "database|odbl", "odbl 1 0", rf"open database {L}|odbl", "opendatacommons org licenses odbl"),
    Family("odc-by-1.0", "commons| odc~", "odc by 1 0", rf"open data commons attribution {L}|odc by", "opendatacommons org licenses by"),
    Family("pddl-1.0", "dedication|pddl", "pddl 1 0", rf"public domain dedication and {L}|pddl", "opendatacommons org licenses pddl"),
    Family("osl-3.0", " open~| osl~", "osl 3 0", rf"open software {L}(?: {_v('3')})?"),
    Family("afl-3.0", "academic| afl~", "afl 3 0", rf"academic free {L}(?: {_v('3')})?"),
    Family("ecl-2.0", "educational| ecl~", "ecl 2 0", rf"educational community {L}(?: {_v('2')})?"),
    Family("ms-pl", "microsoft| ms~", "ms pl", rf"microsoft public {L}|ms pl"),
    Family("ms-rl", "microsoft| ms~", "ms rl", rf"microsoft reciprocal {L}|ms rl"),
    Family("mulan-psl-2.0", "mulan", "mulanpsl 2 0", rf"mulan (?:permissive software {L}|psl)(?: {_v('2')})?"),
    Family("openssl", "openssl", "openssl", rf"openssl {L}"),
    Family("php-3.01", " php~", "php 3 01", rf"php {L}(?: {_v('3', '01')})?"),
    Family("ruby", " ruby~", "ruby", rf"ruby {L}"),
    Family("postgresql", "postgresql", "postgresql", rf"postgresql {L}"),
    Family("ncsa", "ncsa", "ncsa", rf"(?:university of illinois )?ncsa (?:open source )?{L}"),
    Family("vim", " vim~", "vim", rf"vim {L}"),
    Family("sspl-1.0", "server|sspl", "sspl 1 0", rf"server side public {L}|sspl"),
    Family("elastic-2.0", "elastic", "elastic 2 0", rf"elastic {L}(?: {_v('2')})?"),
    Family("openrail-m", "rail", "openrail m|bigscience openrail m", rf"(?:creativeml |bigscience |bigcode )?open ?rail m?(?: {L})?"),
    Family("llama-community", "llama", "llama 2|llama 3", rf"llama {ANY}(?: {ANY})? community {L}"),
    Family("upl-1.0", "universal| upl~", "upl 1 0", rf"universal permissive {L}(?: {_v('1')})?"),
    Family("w3c", "w3c", "w3c", rf"w3c software (?:notice and )?{L}"),
]

#: (kind, priority, text of the rule with the family's parts).
TEMPLATES = (
    ("tag", 0, lambda f: rf"spdx {L} identifier (?:\( )?(?:{f.ids})"),
    ("field", 0, lambda f: rf"{L} (?:id|identifier|expression|name|type) (?:{f.ids})"),
    ("grant", 1, lambda f: rf"{NOTICE}(?:{f.name})(?: {L})?"),
    ("address", 1, lambda f: rf"(?:https? )?(?:www )?{f.address}" if f.address else ""),
    ("title", 2, lambda f: rf"(?:the )?(?:{f.name})"),
    ("short", 3, lambda f: rf"(?:{f.ids}) {L}"),
)

#: (label, priority, keyword, rule) of rules without a family or a version.
OTHER = [
    ("mit", 2, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 2, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 2, "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", 3, "bsd", rf"(?:{NOTICE})?(?:the |a )?bsd {L}"),
    ("apache", 3, "apache", rf"(?:{NOTICE})?(?:the )?apache (?:software )?{L}"),
    ("gpl", 3, "general", rf"(?:{NOTICE})?(?:the )?(?:gnu )?general public {L}"),
    ("lgpl", 3, "general", rf"(?:{NOTICE})?(?:the )?(?:gnu )?(?:lesser|library) general public {L}"),
    ("agpl", 3, "affero", rf"(?:{NOTICE})?(?:the )?(?:gnu )?affero general public {L}"),
    ("gfdl", 3, "documentation", rf"(?:{NOTICE})?(?:the )?(?:gnu )?free documentation {L}"),
    ("mpl", 3, "mozilla", rf"(?:{NOTICE})?(?:the )?mozilla public {L}"),
    ("epl", 3, "eclipse", rf"(?:{NOTICE})?(?:the )?eclipse public {L}"),
    ("cc", 3, "commons", rf"(?:{NOTICE})?(?:the |a )?creative commons(?: {ANY}){{0,3}}? {L}"),
    ("proprietary", 2, "reserved", r"all rights reserved"),
    ("proprietary", 2, "confidential", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", 2, "permission", r"(?:may|must) not be (?:reproduced|copied|distributed)(?: [^ ~]+){0,8}? without (?:the )?(?:prior )?(?:written )?permission"),
    ("public-domain", 2, "public", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("warranty-disclaimer", 3, "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
]

_GPL, _LGPL, _AGPL = rf"(?:gnu )?general public {L}", rf"(?:gnu )?(?:lesser|library) general public {L}", rf"(?:gnu )?affero general public {L}"
_FSF = "(?: as published by the free software foundation(?: inc)?)?"
NEGATED = "not-granted"


def _versions(label: str, keyword: str, words: str, version: str) -> list[tuple[str, int, str, str]]:
    """A GNU license's version before its name, or in a later clause, and with the choice of later ones."""
    return [
        (label, 1, keyword, rf"version {version}(?: only)? of the {words}{_FSF}"),
        (label, 1, keyword, rf"{words}{_FSF} version {version} (?:only )?of the {L}"),
        (f"{label}-or-later", 1, keyword, rf"{words}{_FSF}(?: either)? version {version}(?: of the {L})? or (?:at your option )?any later version"),
        (f"{label}-or-later", 1, keyword, rf"(?:either )?version {version} of the {words}{_FSF} or (?:at your option )?any later version"),
    ]


def _file_notice(label: str, keyword: str, words: str) -> tuple[str, int, str, str]:
    return label, 1, keyword, rf"(?:subject to|licensed under) the (?:terms of the )?{words}(?: {ANY}){{0,8}}? you may not use this file except in compliance with the {L}"


#: (label, priority, keyword, rule), written by hand from the notices themselves.
NOTICES = [
    *_versions("gpl-1.0", "general", _GPL, "1"),
    *_versions("gpl-2.0", "general", _GPL, "2"),
    *_versions("gpl-3.0", "general", _GPL, "3"),
    *_versions("lgpl-2.0", "general", _LGPL, "2"),
    *_versions("lgpl-2.1", "general", _LGPL, "2 1"),
    *_versions("lgpl-3.0", "general", _LGPL, "3"),
    *_versions("agpl-3.0", "affero", _AGPL, "3"),
    _file_notice("apache-2.0", "compliance", rf"apache {L}"),
    _file_notice("mpl-1.1", "compliance", rf"mozilla public {L}"),
    _file_notice("cddl-1.0", "compliance", rf"common development and distribution {L}"),
    _file_notice("ecl-2.0", "compliance", rf"educational community {L}"),
    ("apache-2.0", 2, "compliance", rf"you may not use this (?:file|work|software) except in compliance with the {L}"),
    ("apache-2.0", 2, "applicable", rf"unless required by applicable law or agreed to in writing software distributed under the {L} is distributed on an as is basis"),
    ("apache-2.0", 2, "perpetual", rf"perpetual worldwide non ?exclusive no charge royalty free irrevocable copyright {L}"),
    ("mit", 2, "substantial", r"(?:this|the above) (?:copyright notice and this )?permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 1, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", 1, "advertising", r"the name of (?:the )?(?:x consortium|copyright holders?|authors?|above) shall not be used in advertising or otherwise to promote the sale"),
    ("isc", 1, "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("isc", 2, "permission", r"permission to use copy modify and distribute this software for any purpose"),
    ("hpnd", 1, "permission", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose"),
    ("bsl-1.0", 1, "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsd-3-clause", 1, "endorse", rf"neither the names? (?:{ANY} ){{1,20}}?may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 2, "endorse", r"the names? of (?:the )?(?:authors?|copyright holders?|contributors) may not be used to endorse or promote products"),
    ("bsd", 2, "redistributions", r"redistributions of source code must retain the(?: above)? copyright notice"),
    ("bsd", 2, "redistributions", r"redistributions in binary form must reproduce the(?: above)? copyright notice"),
    ("bsd-4-clause", 1, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-0-clause", 1, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("zlib", 2, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 2, "plainly", r"altered source versions must be plainly marked as such"),
    ("zlib", 2, "liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", 1, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", 1, "waived", r"waived all copyright and (?:all )?related (?:or|and) neighbou?ring rights"),
    ("wtfpl", 1, "want", r"you just do what the (?:fuck|f) you want to"),
    ("beerware", 1, "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", 2, "beer", rf"(?:the )?beer ?ware {L}"),
    ("json", 1, " evil~", r"the software shall be used for good not evil"),
    ("mpl-2.0", 1, " mpl~", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 2, "provisions", r"the contents of this file (?:are|may be) (?:subject to|used under) the (?:terms|provisions) of"),
    ("sleepycat", 2, "sleepycat", rf"sleepycat {L}"),
    ("openldap-2.8", 2, "openldap", rf"openldap public {L}(?: {_v('2', '8')})?"),
    ("ijg", 2, "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", 2, "freetype", rf"freetype (?:project )?{L}"),
    ("imagemagick", 2, "imagemagick", rf"imagemagick {L}"),
    ("curl", 2, " curl~", rf"curl {L}"),
    ("icu", 2, " icu~", rf"icu {L}"),
    ("unicode", 2, "unicode", rf"unicode (?:{L} agreement|{L} v3|inc {L})"),
    ("artistic-or-gpl", 1, " perl~", r"under the same terms as (?:the )?perl(?: itself|5| 5)?(?: programming language)?"),
    ("psf-2.0", 2, "python", rf"psf {L} agreement for python"),
    ("ofl-1.1", 1, "reserved", r"with reserved font names?"),
    ("cc", 3, "redistribute", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc", 3, "attribution", r"you must give appropriate credit provide a link to the licen[sc]e"),
    ("classpath-exception", 1, "classpath", r"(?:with )?(?:the )?(?:gnu )?classpath(?: linking)? exception(?: 2 0)?"),
    ("classpath-exception", 1, "independent", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gcc-exception", 1, "runtime", r"(?:with )?(?:the )?gcc runtime library exception(?: version)?(?: 3 1)?"),
    ("llvm-exception", 1, "llvm", r"(?:with )?(?:the )?llvm exceptions?"),
    ("openssl-exception", 1, "openssl", r"permission to link (?:the code of )?(?:portions of )?this program with (?:the )?openssl"),
    ("bison-exception", 1, "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", 1, "autoconf", rf"as a special exception (?:{ANY} ){{1,30}}?configuration script generated by autoconf"),
    ("linux-syscall-note", 1, "syscall", r"(?:with )?linux syscall note"),
    ("font-exception", 1, " font~", r"(?:with )?(?:gpl )?font exception"),
    ("commons-clause", 1, "clause", rf"commons clause(?: {L})?(?: condition)?(?: v1 0)?"),
    ("busl-1.1", 2, "additional", r"additional use grant"),
    ("elastic-2.0", 1, "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("eula", 2, "agreement", rf"end user {L} agreement"),
    ("non-commercial", 2, "commercial", r"(?:for )?(?:personal(?: and)? )?non ?commercial (?:use|purposes) only"),
    ("non-commercial", 2, "purposes", r"for (?:academic|research|educational|evaluation) (?:and non ?commercial )?purposes only"),
    ("proprietary", 2, "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)(?: or [^ ~]+)? of this (?:file|software|program|document|work)"),
    ("proprietary", 2, "publication", r"no part of this publication may be reproduced"),
    ("proprietary", 2, "secrets", r"contains (?:confidential (?:information )?and )?trade secrets of"),
    ("proprietary", 2, "internal", r"for internal use only"),
    ("warranty-disclaimer", 3, "warrant", r"without any express or implied warrant(?:y|ies)"),
    ("warranty-disclaimer", 3, "merchantability", r"(?:implied )?warrant(?:y|ies) of merchantability"),
    ("warranty-disclaimer", 3, "warrant", rf"provided (?:by (?:{ANY} ){{1,10}})?as is and any express or implied warranties"),
    (NEGATED, 0, " not~| never~| longer~| nor~| t~", rf"(?:not|never|no longer|nor|t) (?:been |be )?{NOTICE}(?:{ANY} ){{0,6}}?{L}"),
]


#: What most rules can't match without, whatever their other words.
STEM = "licen"


def _group_end(text: str, at: int) -> int:
    depth = 0
    for k in range(at, len(text)):
        if text[k - 1] != "\\":
            depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return k
    raise ValueError(text)


def always_has(text: str, word: str = STEM) -> bool:
    """Whether every match of a rule's text contains the word: each alternative does, outside of what may be left out."""
    runs, group, run, k = [], False, "", 0  # of one alternative: its literal runs, and whether a group of it always has the word
    while k < len(text):
        c = text[k]
        if c == "|":
            if not (group or word in "\n".join([*runs, run])):
                return False
            runs, group, run = [], False, ""
        elif c == "\\":
            runs, run, k = [*runs, run], "", k + 1
        elif c in "([":
            end = _group_end(text, k) if c == "(" else text.index("]", k)
            may_lack = text[end + 1 : end + 2] in ("?", "*") or text[end + 1 :].startswith("{0")
            group = group or c == "(" and not may_lack and always_has(text[k + 3 : end], word)
            runs, run, k = [*runs, run], "", end
        elif text[k + 1 : k + 2] in ("?", "*"):
            runs, run = [*runs, run], ""
        elif c in "?*+{}":
            runs, run = [*runs, run], ""
        else:
            run += c
        k += 1
    return group or word in "\n".join([*runs, run])


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    keyword: str
    text: str
    also: str  # what a match contains besides, or nothing


def _also(keyword: str, text: str) -> str:
    """STEM, or else the longest word that isn't the keyword, if every match has one."""
    if always_has(text):
        return STEM
    words = {w for w in re.findall("[a-z0-9]{4,}", text) if always_has(text, w) and w not in keyword.strip(" ~").split("|")}
    return max(sorted(words), key=len, default="")


def _rule(label: str, kind: str, priority: int, keyword: str, text: str) -> Rule:
    return Rule(label, kind, priority, keyword, text, _also(keyword, text))


def rules() -> list[Rule]:
    out = [_rule(f.label, kind, p, f.keyword, text) for kind, p, make in TEMPLATES for f in FAMILIES if (text := make(f))]
    out += [_rule(label, "other", p, keyword, text) for label, p, keyword, text in OTHER]
    out += [_rule(label, "notice", p, keyword, text) for label, p, keyword, text in NOTICES]
    return sorted(out, key=lambda r: (r.priority, r.label, r.kind))
