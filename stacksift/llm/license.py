"""License scans: ordered signature rules behind keyword gates, with containment suppression."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksift.llm.common import renamed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but for letters and digits.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Detections that are compared with each other at a time, with those around them.
CHUNK = 64


@dataclass(frozen=True)
class Rule:
    """regex matches lower-case words joined by single spaces, and has the literal gate in all its matches.

    Of detections that contain each other, the one of higher priority stays; see scan().
    """

    label: str
    regex: str
    gate: str
    priority: int
    weight: float
    base: bool = False


def dotted(version: str) -> str:
    return version.replace(".", " ")


#: The four base phrases with their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Families with versions: label, name as a regex, a word all its matches have, short ids as a regex, versions.
VERSIONED = [
    ("gpl", "(?:gnu )?general public license", "general public", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license", "general public", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "(?:gnu )?affero general public license", "affero", "(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "(?:gnu )?free documentation license", "documentation", "(?:gnu )?(?:gfdl|fdl)", "1.1 1.2 1.3"),
    ("apache", "apache (?:software )?license", "apache", "apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla public license", "mozilla", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public license", "eclipse", "epl", "1.0 2.0"),
    ("cddl", "common development and distribution license", "distribution", "cddl", "1.0 1.1"),
    ("eupl", "european union public licen[cs]e", "european", "eupl", "1.0 1.1 1.2"),
    ("afl", "academic free license", "academic", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software license", "open software", "osl", "1.0 1.1 2.0 2.1 3.0"),
    ("artistic", "artistic license", "artistic", "artistic", "1.0 2.0"),
    ("ofl", "(?:sil )?open font license", "font", "ofl", "1.0 1.1"),
    ("cecill", "cecill (?:free software )?licen[cs]e(?: agreement)?", "cecill", "cecill", "1.0 1.1 2.0 2.1"),
    ("lppl", "latex project public license", "latex", "lppl", "1.0 1.1 1.2 1.3"),
    ("zpl", "zope public license", "zope", "zpl", "1.1 2.0 2.1"),
    ("php", "php license", "php", "php", "3.0 3.01"),
    ("psf", "(?:python software foundation|psf) license(?: agreement)?", "license", "psf", "2.0"),
    ("ecl", "educational community license", "educational", "ecl", "1.0 2.0"),
    ("cpl", "common public license", "common public", "cpl", "1.0"),
    ("bsl", "boost software license", "boost", "bsl", "1.0"),
    ("busl", "business source license", "business", "busl", "1.0 1.1"),
    ("sspl", "server side public license", "server side", "sspl", "1.0"),
    ("elastic", "elastic license", "elastic", "elastic", "1.0 2.0"),
    ("mulan", "mulan (?:permissive software|psl) license", "mulan", "mulanpsl", "1.0 2.0"),
    ("upl", "universal permissive license", "universal", "upl", "1.0"),
    ("odbl", "open (?:data ?base|database) license", "open", "odbl", "1.0"),
    ("qpl", "q public license", "q public", "qpl", "1.0"),
    ("nasa", "nasa open source agreement", "nasa", "nasa", "1.3"),
    ("nposl", "non profit open software license", "non profit", "nposl", "3.0"),
    ("rpl", "reciprocal public license", "reciprocal", "rpl", "1.1 1.5"),
    ("apsl", "apple public source license", "apple", "apsl", "1.0 1.1 1.2 2.0"),
    ("w3c", "w3c (?:software )?(?:notice and )?license", "w3c", "w3c", "1.0 2.0"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) license", "polyform", "polyform", "1.0"),
    ("cern-ohl", "cern open hardware licen[cs]e", "cern", "cern ohl", "1.1 1.2 2.0"),
]
#: Creative Commons: elements and versions.
COMMONS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:s|atives|ative works)",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:s|atives|ative works)",
}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: Other licenses, by one regex each: label, regex, a literal all its matches have.
PLAIN = [
    ("mit", "(?:the )?mit licen[cs]e", "mit"), ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby"),
    ("mit-0", "mit no attribution", "no attribution"), ("x11", "x11 licen[cs]e", "x11"), ("isc", "isc licen[cs]e", "isc"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", "permission to use"),
    ("bsd-0-clause", "(?:zero|0) clause bsd(?: license)?", "clause"), ("bsd-1-clause", "(?:one|1) clause bsd(?: license)?|bsd (?:one|1) clause(?: license)?", "clause"),
    ("bsd-2-clause", "(?:two|2) clause bsd(?: license)?|bsd (?:two|2) clause(?: license)?|(?:simplified|freebsd) bsd license|simplified bsd license", "bsd"),
    ("bsd-3-clause", "(?:three|3) clause bsd(?: license)?|bsd (?:three|3) clause(?: license)?|(?:new|modified|revised) bsd license", "bsd"),
    ("bsd-4-clause", "(?:four|4) clause bsd(?: license)?|bsd (?:four|4) clause(?: license)?|original bsd license", "bsd"), ("bsd", "bsd (?:style )?licen[cs]e", "bsd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("zlib", "zlib (?:libpng )?licen[cs]e", "zlib"), ("libpng", "libpng licen[cs]e", "libpng"), ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered"), ("wtfpl", "do what the fuck you want to public license", "want to"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0"), ("cc0", "creative commons zero", "creative commons zero"), ("public-domain", "(?:released into|placed in|in) the public domain", "public domain"),
    ("public-domain", "public domain dedication", "dedication"), ("pddl", "public domain dedication and licen[cs]e", "dedication"), ("odc-by", "open data commons attribution license", "open data"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"), ("openssl", "openssl licen[cs]e", "openssl"), ("ruby", "ruby licen[cs]e", "ruby"), ("curl", "curl licen[cs]e", "curl"),
    ("vim", "vim licen[cs]e", "vim"), ("json", "json licen[cs]e", "json"), ("json", "shall be used for good not evil", "good not evil"), ("beerware", "beer ?ware licen[cs]e", "beer"),
    ("ncsa", "(?:university of illinois )?ncsa open source license", "ncsa"), ("ms-pl", "microsoft public license", "microsoft"), ("ms-rl", "microsoft reciprocal license", "microsoft"),
    ("ijg", "independent jpeg group license", "jpeg"), ("sleepycat", "sleepycat license", "sleepycat"), ("hpnd", "historical permission notice and disclaimer", "historical permission"),
    ("unicode", "unicode (?:inc )?licen[cs]e(?: agreement)?", "unicode"), ("blueoak", "blue oak model license", "blue oak"), ("commons-clause", "commons clause", "commons clause"),
    ("openrail", "(?:creativeml )?open ?rail(?: m)? licen[cs]e", "rail"), ("llama", "llama (?:[0-9] ){0,2}community license(?: agreement)?", "llama"), ("gemma", "gemma terms of use", "gemma"),
    ("proprietary", "proprietary licen[cs]e", "proprietary"), ("proprietary", "all rights reserved", "all rights reserved"), ("eula", "end user licen[cs]e agreement", "end user"),
    ("copyright-notice", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright"), ("no-warranty", "without warrant(?:y|ies) (?:of any kind|or conditions of any kind)", "without warrant"),
    ("no-warranty", "provided as is without warranty", "without warrant"), ("permissive-hint", "permission is granted", "permission is granted"), ("copyleft-hint", "copyleft", "copyleft"),
    ("creative-commons", "creative ?commons (?:org )?licen[cs]es?", "commons"), ("license-hint", "licensed under the (?:terms of the )?[^ ]+ licen[cs]e", "licensed under"),
    ("license-hint", "released under the [^ ]+ licen[cs]e", "released under"), ("license-hint", "spdx license identifier [^ ]+", "spdx"), ("license-hint", "dual licensed", "dual licensed"),
    ("aladdin", "aladdin free public license", "aladdin"), ("adobe", "adobe systems incorporated source code license", "adobe"), ("adobe-utopia", "utopia font license", "utopia"),
    ("amazon", "amazon (?:digital services|software) license", "amazon"), ("apafml", "adobe postscript afm license", "afm"), ("arphic", "arphic public license", "arphic"),
    ("bahyph", "bahyph license", "bahyph"), ("barr", "barr license", "barr"), ("bigscience-rail", "bigscience (?:bloom )?(?:open ?)?rail license", "bigscience"), ("bittorrent", "bittorrent open source license", "bittorrent"),
    ("bitstream-vera", "bitstream vera (?:fonts? )?(?:copyright|license)", "bitstream"), ("borceux", "borceux license", "borceux"), ("bzip2", "bzip2(?: and libbzip2)? license", "bzip2"), ("c-uda", "computational use of data agreement", "computational use"),
    ("caldera", "caldera license", "caldera"), ("catosl", "computer associates trusted open source license", "computer associates"), ("cdla-permissive", "community data license agreement permissive", "community data"),
    ("cdla-sharing", "community data license agreement sharing", "community data"), ("clartistic", "clarified artistic license", "clarified"), ("cnri", "cnri (?:python |jython )?(?:open source )?license", "cnri"), ("condor", "condor public license", "condor"),
    ("copyfair", "copyfair licen[cs]e", "copyfair"), ("cpal", "common public attribution license", "public attribution"), ("cua-opl", "cua office public license", "cua office"), ("crossword", "crossword license", "crossword"),
    ("crystal-stacker", "crystal stacker license", "crystal stacker"), ("cube", "cube license", "cube license"), ("d-fsl", "deutsche freie software lizenz", "freie software"), ("diffmark", "diffmark license", "diffmark"),
    ("dotseqn", "dotseqn license", "dotseqn"), ("drl", "detection rule license", "detection rule"), ("dsdp", "dsdp license", "dsdp"), ("efl", "eiffel forum license", "eiffel forum"), ("egenix", "egenix com public license agreement", "egenix"),
    ("entessa", "entessa public license", "entessa"), ("epics", "epics open license", "epics"), ("erlang", "erlang public license", "erlang"), ("etalab", "licence ouverte", "ouverte"), ("etalab", "etalab open licen[cs]e", "etalab"), ("eudatagrid", "eu datagrid software license", "datagrid"),
    ("fair", "fair license", "fair license"), ("falcon", "falcon (?:llm |180b )?(?:tii )?license", "falcon"), ("frameworx", "frameworx open license", "frameworx"), ("freeimage", "freeimage public license", "freeimage"), ("freetype", "freetype (?:project )?license", "freetype"),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty", "without royalty"), ("ftl", "the freetype project license", "freetype"), ("giftware", "giftware licen[cs]e", "giftware"),
    ("glide", "3dfx glide source code general public license", "3dfx"), ("gnuplot", "gnuplot license", "gnuplot"), ("haskell-report", "haskell language report license", "haskell"), ("hippocratic", "hippocratic license", "hippocratic"), ("ibm-pibs", "ibm powerpc initialization and boot software", "powerpc"),
    ("icu", "icu license", "icu license"), ("imagemagick", "imagemagick license", "imagemagick"), ("imatix", "imatix standard function library agreement", "imatix"), ("info-zip", "info zip license", "info zip"), ("intel", "intel open source license", "intel open"),
    ("interbase", "interbase public license", "interbase"), ("ipa", "ipa font license", "ipa font"), ("ipl", "ibm public license", "ibm public"), ("jasper", "jasper license", "jasper"), ("leptonica", "leptonica license", "leptonica"), ("libtiff", "libtiff license", "libtiff"),
    ("liliq", "licence libre du (?:quebec|québec)", "licence libre"), ("linux-openib", "linux kernel variant of openib org license", "openib"), ("lpl", "lucent public license", "lucent"), ("makeindex", "makeindex license", "makeindex"), ("miros", "miros licence", "miros"),
    ("motosoto", "motosoto open source license", "motosoto"), ("mpich2", "mpich2? license", "mpich"), ("mtll", "matrix template library license", "matrix template"), ("multics", "multics license", "multics"), ("naumen", "naumen public license", "naumen"),
    ("nbpl", "net boolean public license", "net boolean"), ("net-snmp", "net snmp license", "net snmp"), ("netcdf", "netcdf license", "netcdf"), ("ngpl", "nethack general public license", "nethack"), ("nlod", "norwegian licen[cs]e for open government data", "norwegian"),
    ("nokia", "nokia open source license", "nokia"), ("noweb", "noweb license", "noweb"), ("npl", "netscape public license", "netscape"), ("ntp", "ntp license", "ntp license"), ("o-uda", "open use of data agreement", "open use"), ("occt", "open cascade technology public license", "open cascade"),
    ("oclc", "oclc research public license", "oclc"), ("ogl", "open government licen[cs]e", "open government"), ("ogtsl", "open group test suite license", "open group"), ("oldap", "openldap public license", "openldap"), ("oml", "open market license", "open market"),
    ("oset", "oset public license", "oset public"), ("parity", "parity public license", "parity"), ("plexus", "plexus classworlds license", "plexus"), ("prosperity", "prosperity public license", "prosperity"), ("radvd", "radvd license", "radvd"), ("rhecos", "red hat ecos public license", "ecos public"),
    ("rpsl", "realnetworks public source license", "realnetworks"), ("rsa-md", "rsa data security inc md[45] message digest algorithm", "message digest"), ("saxpath", "saxpath license", "saxpath"), ("scea", "scea shared source license", "scea"), ("sgi-b", "sgi free software license b", "sgi free"),
    ("simpl", "simple public license", "simple public"), ("sissl", "sun industry standards source license", "sun industry"), ("smlnj", "standard ml of new jersey license", "new jersey"), ("snia", "snia public license", "snia"), ("spencer", "henry spencer license", "spencer"),
    ("spl", "sun public license", "sun public"), ("swl", "scheme widget library license", "scheme widget"), ("tcl", "tcl tk license", "tcl tk"), ("torque", "torque v?[0-9 ]*software license", "torque"), ("unicode-tou", "unicode terms of use", "unicode terms"), ("vostrom", "vostrom public license", "vostrom"),
    ("watcom", "sybase open watcom public license", "watcom"), ("wsuipa", "wsuipa license", "wsuipa"), ("xerox", "xerox license", "xerox"), ("xfree86", "xfree86 license", "xfree86"), ("xinetd", "xinetd license", "xinetd"), ("xnet", "x net license", "x net"), ("xpp", "xpp license", "xpp license"),
    ("ypl", "yahoo public license", "yahoo"), ("zed", "zed license", "zed license"), ("zend", "zend license", "zend"), ("zimbra", "zimbra public license", "zimbra"), ("shareware", "shareware licen[cs]e", "shareware"), ("freeware", "freeware licen[cs]e", "freeware"), ("evaluation", "evaluation licen[cs]e agreement", "evaluation"),
]


def rules() -> list[Rule]:
    """All rules in order: base phrases, families by version, Creative Commons, the rest.

    Priorities: 40 for an exact version, 30 for a named license, 20 for a base phrase, 10 for a hint.
    """
    out = [Rule(label, phrase, phrase, 20, 0.8, True) for phrase, label in BASE]
    lead = "(?:licen[cs]ed? (?:under )?(?:the )?|spdx license identifier )"
    for label, name, gate, ids, versions in VERSIONED:
        out.append(Rule(label, name, gate, 30, 0.8))
        for v in versions.split():
            short = dotted(v) if not v.endswith(".0") else f"{v[:-2]}(?: 0)?"
            out.append(Rule(f"{label}-{v}", f"{name}(?: as published by the free software foundation)?(?: either)? (?:version |v ?){short}", gate, 40, 0.95))
            out.append(Rule(f"{label}-{v}", f"{lead}{ids}(?: v)? ?{short}(?: only)?", "licen", 40, 0.9))
            out.append(Rule(f"{label}-{v}-or-later", f"{name}(?: as published by the free software foundation)?(?: either)? (?:version |v ?){short} or (?:at your option )?(?:any )?later(?: version)?", gate, 45, 0.95))
    for kind, name in COMMONS.items():
        ids = "cc " + kind.replace("-", " ")
        out.append(Rule(f"cc-{kind}", ids, "cc by", 31 + kind.count("-"), 0.8))
        out.append(Rule(f"cc-{kind}", f"creative ?commons {name}", "commons", 31 + kind.count("-"), 0.85))
        for v in COMMONS_VERSIONS.split():
            out.append(Rule(f"cc-{kind}-{v}", f"{ids} {dotted(v)}", "cc by", 40 + kind.count("-"), 0.95))
            out.append(Rule(f"cc-{kind}-{v}", f"creative ?commons {name} {dotted(v)}(?: international| unported| generic)?", "commons", 40 + kind.count("-"), 0.95))
            out.append(Rule(f"cc-{kind}-{v}", f"creativecommons org licenses {kind.replace('-', ' ')} {dotted(v)}", "creativecommons", 40 + kind.count("-"), 0.95))
    for label, regex, gate in PLAIN:
        hint = label.endswith("-hint") or label in ("copyright-notice", "no-warranty")
        out.append(Rule(label, regex, gate, 10 if hint else 30, 0.4 if hint else 0.8))
    return out


def coarse_gates(table: list[Rule]) -> list[str]:
    """A few literals, one of which every text has that any rule matches: "licen" where a regex always has it, else the rule's gate."""
    out = {"licen"}
    for r in table:
        always = re.sub(r"\(\?:[^()]*\)\??", "", r.regex)
        if "licen" not in always or "|" in always:
            out.add(r.gate)
    return sorted(g for g in out if not any(o != g and o in g for o in out))


RULE_TYPE = "array<struct<label: string, regex: string, gate: string, priority: int, weight: double, base: boolean>>"


def normalized(text: Column) -> Column:
    """Lower-case words between single spaces, with a space at both ends; two spaces for a text without words."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, "  +", " ")), F.lit(" "))


FOUND_TYPE = "array<struct<first: bigint, longest: bigint, prior: int, rule: int, last: bigint, label: string, priority: int, weight: double, base: boolean>>"
#: The first place in found, sorted by first, from which d.first >= {x}: by halving.
LOWER_BOUND = """aggregate(sequence(1, 31), named_struct('lo', 0, 'hi', size(found)), (s, _) -> if(s.lo >= s.hi, s,
    if(found[(s.lo + s.hi) div 2].first < {x}, named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"""


def kept_of(found: str) -> str:
    """Of a short array: by priority, then length, then place and rule, each detection that is in no kept one and has no kept one in it."""
    ranked = f"array_sort(transform({found}, d -> named_struct('prior', d.prior, 'length', d.first - d.last, 'd', d)))"
    related = "(e.d.first <= r.d.first and e.d.last >= r.d.last) or (e.d.first >= r.d.first and e.d.last <= r.d.last)"
    kept = f"aggregate({ranked}, filter({ranked}, r -> false), (kept, r) -> if(exists(kept, e -> {related}), kept, array_append(kept, r)))"
    return f"array_sort(transform({kept}, r -> r.d))"


def scan(df: DataFrame, text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """df with n_words, found and kept: arrays of struct(first, last, rule, label, priority, weight, base).

    found has every match of every rule, as word numbers from 0, in order of start. kept is what suppression
    leaves: detections are taken by priority, then the longer first, then by place and rule; one is dropped
    if a kept one contains it or lies in it. Detections that merely overlap, or none of which is kept, do not
    count. Whole texts are scanned; null counts as empty; equal texts get equal results. Other columns,
    repeated rows and empty tables pass through, input columns named as the results as <name>_input. Only
    built-in functions, no shuffle.

    A text meets a rule's regex only where it has the rule's gate, and none without one of coarse_gates().
    What keeps or drops a detection lies within twice its longest neighbour's words for each priority, so
    long texts are worked on in chunks of CHUNK detections with those around them: time follows the length.
    """
    table = rules() if table is None else table
    df = renamed(df, *({"n_words", "found", "kept"} - {text}))
    spec = json.dumps([asdict(r) for r in table])
    n, r = "_scan_norm", "_scan_rules"
    gated = F.lit(False)
    for g in coarse_gates(table):
        gated = gated | F.contains(F.col(n), F.lit(g))
    spaces = f"(length({n}) - length(replace({n}, ' ', '')))"
    first = df.withColumn(n, normalized(F.col(f"`{text}`"))).withColumn("n_words", F.when(F.col(n) == "  ", F.lit(0)).otherwise(F.expr(spaces) - 1).cast("long"))
    every = F.from_json(F.lit(spec), RULE_TYPE)
    gates = F.filter(F.array(*[F.lit(g) for g in sorted({x.gate for x in table})]), lambda g: F.contains(F.col(n), g))
    ready = first.withColumn("_scan_gates", F.when(gated, gates))
    active = F.filter(F.transform(every, lambda x, i: F.struct(i.alias("rule"), x.alias("x"))), lambda y: F.array_contains("_scan_gates", y["x"]["gate"]))
    ready = ready.withColumn(r, F.when(F.size("_scan_gates") > 0, active))
    marked = f"regexp_replace({n}, concat('(?<= )(?:', y.x.regex, ')(?= )'), '\u0001$0\u0002')"
    places = "transform(filter(transform(tokens, (t, i) -> named_struct('t', t, 'i', i)), p -> {0}), p -> cast(p.i - 1 as bigint))"  # tokens[0] is empty
    starts, ends = places.format("startswith(p.t, '\u0001')"), places.format("endswith(p.t, '\u0002')")
    spans = f"zip_with({starts}, {ends}, (a, b) -> named_struct('first', a, 'last', b))"
    none = f"cast(array() as {FOUND_TYPE})"
    one = f"transform(array({marked}), m -> if(instr(m, '\u0001') = 0, null, transform(array(split(m, ' ')), tokens -> {spans})[0]))[0]"
    found = f"""coalesce(array_sort(flatten(transform({r}, y -> coalesce(transform({one}, s -> named_struct(
        'first', s.first, 'longest', -s.last, 'prior', -y.x.priority, 'rule', y.rule, 'last', s.last,
        'label', y.x.label, 'priority', y.x.priority, 'weight', y.x.weight, 'base', y.x.base)), {none})))), {none})"""
    reach = "2 * array_max(transform(found, d -> d.last - d.first + 1)) * size(array_distinct(transform(found, d -> d.prior)))"
    low, high = LOWER_BOUND.format(x="found[c].first - reach"), LOWER_BOUND.format(x=f"found[least(c + {CHUNK}, size(found)) - 1].first + reach + 1")
    around = f"transform(array(named_struct('a', {low}, 'b', {high})), w -> slice(found, w.a + 1, w.b - w.a))[0]"
    own = f"transform(array(slice(found, c + 1, {CHUNK})), own -> filter({kept_of(around)}, d -> array_contains(own, d)))[0]"
    chunked = f"transform(array({reach}), reach -> flatten(transform(sequence(0, size(found) - 1, {CHUNK}), c -> {own})))[0]"
    kept = f"if(size(found) <= {CHUNK}, {kept_of('found')}, {chunked})"
    out = ready.withColumn("found", F.expr(found)).withColumn("kept", F.when(F.size("found") > 1, F.expr(kept)).otherwise(F.col("found")))
    return out.drop(n, r, "_scan_gates")


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan of all documents in digest form: see op6's columns. A label is listed once."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("found", lambda d: d["base"])
    labels = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"])))
    return found.withColumn("of_base", base).select(
        "doc_id",
        "n_words",
        F.size("of_base").cast("long").alias("n_base"),
        F.array_min(F.transform("of_base", lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform("of_base", lambda d: d["first"])).alias("last_word"),
        F.array_join(labels(F.col("of_base")), ",").alias("base_labels"),
        F.array_join(labels(F.concat("of_base", "kept")), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.size("kept").cast("long").alias("n_kept"),
    )
