"""Discourse: elementary units, connectives with their arguments, tree and offset outputs."""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.operators.grammar import CHUNKS, Node, clauses_of

#: Verbs of saying: their complement is no unit of its own (our own list; callers bring theirs).
REPORTING_VERBS = frozenset("sagen meinen schreiben behaupten melden fragen berichten erklären betonen mitteilen ankündigen antworten finden glauben".split())
#: Verbs whose complement without introduction stays in their unit.
THAT_VERBS = frozenset("wissen hoffen glauben denken finden meinen sagen fürchten vermuten bedauern behaupten annehmen zeigen".split())
#: Prepositions that open a unit.
DISCOURSE_PREPOSITIONS = frozenset("wegen trotz angesichts aufgrund dank mangels infolge anlässlich zwecks".split())
QUOTES = frozenset("„“»«\"'")


# --- verb and preposition matching -----------------------------------------------------------------


class VerbTrie:
    """Verb patterns ``particle|stem[lemma/POS]``: the verb's lemma and a dependant it requires."""

    def __init__(self, patterns):
        self.entries: dict[str, list[tuple[str, str] | None]] = {}
        for pattern in patterns:
            stem, _, rest = pattern.strip().partition("[")
            need = tuple((rest[:-1].split("/") + [""])[:2]) if rest else None
            self.entries.setdefault(stem.replace("|", ""), []).append(need)

    def match(self, lemma: str, dependants: list[dict]) -> bool:
        for need in self.entries.get(lemma, []):
            if need is None or any(d.get("lemma") == need[0] and (not need[1] or d["pos"] == need[1]) for d in dependants):
                return True
        return False


def longest_prefix(phrases: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, phrase): the longest phrase that a text begins with, by an equi-join on the first word."""
    left = texts.select(F.col(text).alias("text")).distinct().withColumn("_w", F.element_at(F.split("text", " "), 1))
    right = phrases.select(F.col(phrases.columns[0]).alias("phrase")).distinct().withColumn("_w", F.element_at(F.split("phrase", " "), 1))
    hits = left.join(right, "_w").where((F.col("text") == F.col("phrase")) | F.col("text").startswith(F.concat("phrase", F.lit(" "))))
    return hits.groupBy("text").agg(F.max_by("phrase", F.length("phrase")).alias("phrase"))


# --- elementary units -----------------------------------------------------------------------------------


@dataclass
class Unit:
    """A unit with its type and place in the tree; ``parent`` is the unit it is embedded in."""

    number: int
    kind: str
    parent: int | None = None
    tokens: list[dict] = field(default_factory=list)


class UnitSegmenter:
    """Walks the clause nodes of a sentence and opens units at clauses, parentheses and some PPs."""

    def __init__(self, reporting=REPORTING_VERBS, that_verbs=THAT_VERBS, prepositions=DISCOURSE_PREPOSITIONS):
        self.reporting = VerbTrie(reporting)
        self.that = VerbTrie(that_verbs)
        self.prepositions = prepositions

    def segment(self, tokens: list[dict]) -> list[Unit]:
        self.units: list[Unit] = [Unit(0, "MainCl")]
        previous = None
        for node in clauses_of(tokens):
            self._walk(node, None, previous)
            previous = node
        return [u for u in self.units if u.tokens]

    def _open(self, kind: str, parent: Unit | None = None) -> Unit:
        last = self.units[-1]
        if not last.tokens and parent is None:
            last.kind = kind
            return last
        self.units.append(Unit(len(self.units), kind, parent.number if parent else None))
        return self.units[-1]

    def _fill(self, node: Node, into: Unit) -> None:
        """Tokens of a node go to its unit; clauses inside open their own and the unit goes on after them."""
        previous, kind = None, into.kind
        for i, child in enumerate(node.children):
            if not isinstance(child, Node) and into.kind != kind:
                into = self._open(kind)  # a clause in front took the unit over
            if isinstance(child, Node):
                inside = 0 < i < len(node.children) - 1
                self._walk(child, into if inside else None, previous, into)
            else:
                into.tokens.append(child)
            previous = child

    def _walk(self, node, embedded: Unit | None, previous, current: Unit | None = None) -> None:
        unit = current or self.units[-1]
        if not isinstance(node, Node):
            unit.tokens.append(node)
            return
        if all(isinstance(c, Node) and c.label == node.label or not isinstance(c, Node) and c["pos"] == "KON" for c in node.children) and any(isinstance(c, Node) for c in node.children):
            pending: list[dict] = []
            for child in node.children:  # coordinated clauses: the conjunction opens its conjunct
                if isinstance(child, Node):
                    child.children = pending + child.children
                    pending = []
                    self._walk(child, embedded, previous, None)
                else:
                    pending = [child]
            return
        self._fill(node, getattr(self, "_" + node.label.lower(), self._any)(node, embedded, previous, unit))

    def _any(self, node, embedded, previous, unit):
        return unit

    def _maincl(self, node, embedded, previous, unit):
        verb = node.feats.get("verb")
        if verb is None or not unit.tokens:
            return unit
        dependants = [t for t in node.tokens() if t.get("head") == verb.get("idx")]
        if self.reporting.match(verb.get("lemma", ""), dependants):
            return unit
        before = previous.feats.get("verb") if isinstance(previous, Node) else None
        first = next(node.tokens())
        if before is not None and first["pos"] != "KON" and self.that.match(before.get("lemma", ""), []):
            return unit
        return self._open("MainCl", embedded)

    def _sntsubcl(self, node, embedded, previous, unit):
        heads = [t.get("lemma") for t in list(node.tokens())[:3]]
        if any(h in ("dass", "daß", "ob") for h in heads) and "so" not in heads:
            return unit
        return self._open("SubCl", embedded)

    def _infsubcl(self, node, embedded, previous, unit):
        return self._open("SubCl", embedded)

    def _relcl(self, node, embedded, previous, unit):
        return self._open("RelCl", embedded)

    def _intcl(self, node, embedded, previous, unit):
        return self._open("SubCl", embedded) if any(t["form"] in ("weshalb", "weswegen") for t in list(node.tokens())[:2]) else unit

    def _paren(self, node, embedded, previous, unit):
        tokens = list(node.tokens())
        if tokens[0]["form"] not in QUOTES and any(t["pos"].startswith("VV") for t in tokens):
            return self._open("Paren", embedded)
        return unit

    def _pc(self, node, embedded, previous, unit):
        first = next(node.tokens())
        if first["form"].lower() in self.prepositions and unit.tokens:
            return self._open("DiPP", unit)
        return unit


UNIT_DDL = "doc_id string, sent_id int, unit_no int, kind string, parent int, first_idx int, last_idx int, n_tokens int, text string"


def discourse_units(tokens: DataFrame) -> DataFrame:
    """Units of each sentence; the tokens of a sentence are gathered first, the grammar runs on Arrow batches."""
    item = F.struct("idx", F.coalesce("form", F.lit("")).alias("form"), F.coalesce("lemma", "form", F.lit("")).alias("lemma"), F.coalesce("pos", F.lit("XY")).alias("pos"), F.coalesce("phead", F.lit(-1)).alias("head"), F.coalesce("feat", F.lit("")).alias("feat"))
    rows = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(item)).alias("tokens"))

    def run(batches):
        segmenter = UnitSegmenter()
        for batch in batches:
            out = []
            for doc, sent, toks in zip(batch["doc_id"], batch["sent_id"], batch["tokens"]):
                items = [dict(t) | {"feats": tuple(t["feat"].replace("|", " ").split())} for t in toks]
                for unit in segmenter.segment(items):
                    ids = [t["idx"] for t in unit.tokens]
                    out.append((doc, sent, unit.number, unit.kind, unit.parent, min(ids), max(ids), len(ids), " ".join(t["form"] for t in unit.tokens)))
            yield pd.DataFrame(out, columns=["doc_id", "sent_id", "unit_no", "kind", "parent", "first_idx", "last_idx", "n_tokens", "text"]).astype({"parent": "Int32"})

    return rows.mapInPandas(run, UNIT_DDL)


CHUNK_DDL = "doc_id string, sent_id int, label string, first_idx int, last_idx int"


def chunks(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, label, first_idx, last_idx) of the chunks of each sentence."""
    item = F.struct("idx", F.coalesce("form", F.lit("")).alias("form"), F.coalesce("lemma", F.lit("")).alias("lemma"), F.coalesce("pos", F.lit("XY")).alias("pos"), F.coalesce("feat", F.lit("")).alias("feat"))
    rows = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(item)).alias("tokens"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, sent, toks in zip(batch["doc_id"], batch["sent_id"], batch["tokens"]):
                for node in CHUNKS.parse([dict(t) | {"feats": tuple(t["feat"].replace("|", " ").split())} for t in toks]):
                    if isinstance(node, Node):
                        ids = [t["idx"] for t in node.tokens()]
                        out.append((doc, sent, node.label, min(ids), max(ids)))
            yield pd.DataFrame(out, columns=["doc_id", "sent_id", "label", "first_idx", "last_idx"])

    return rows.mapInPandas(run, CHUNK_DDL)


# --- connectives ------------------------------------------------------------------------------------------

#: A small connective lexicon of our own: parts, syntactic type, order flags, relations.
CONNECTIVES = [
    (["weil"], "subj", True, True, True, ["cause"]), (["obwohl"], "subj", True, True, True, ["concession"]), (["wenn"], "subj", True, True, True, ["condition"]), (["bevor"], "subj", True, True, False, ["temporal"]),
    (["sobald"], "subj", True, True, False, ["temporal"]), (["denn"], "conj", False, True, False, ["cause"]), (["aber"], "conj", False, True, True, ["contrast"]), (["und"], "conj", False, True, False, ["list"]),
    (["trotzdem"], "adv", False, True, True, ["concession"]), (["deshalb"], "adv", False, True, True, ["result"]), (["wegen"], "prep", True, True, False, ["cause"]), (["trotz"], "prep", True, True, False, ["concession"]),
    (["entweder", "oder"], "conj", False, True, False, ["disjunction"]), (["zwar", "aber"], "conj", False, True, False, ["concession"]), (["ohne dass"], "subj", False, True, False, ["manner"]),
]
CONNECTIVE_DDL = "orth array<string>, type string, ante boolean, post boolean, insert boolean, rel array<string>"


#: A lexicon is a closed vocabulary; one with more entries is refused.
MAX_ENTRIES = 20_000


class ConnectiveMatcher:
    """Finds the entries of a lexicon in a sentence: any number of parts, each of any number of words.

    The parts of an entry follow each other, each at its first place behind the part before it. Of chains that
    share their second part the one that begins last counts; words of later parts are no connectives
    of their own. Of several entries at a place the longest wins, and a token belongs to one.
    """

    def __init__(self, entries: list[tuple[list[str], str, list[str]]]):
        self.entries = entries
        self.parts: dict[str, list[tuple[int, int, list[str]]]] = {}
        for number, (orth, _, _) in enumerate(entries):
            for k, part in enumerate(orth):
                words = part.split(" ")
                self.parts.setdefault(words[0], []).append((number, k, words))

    def match(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first, last, entry number) by place in the lower-case words of a sentence."""
        hits: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for at, word in enumerate(words):
            for number, k, part in self.parts.get(word, ()):
                if words[at : at + len(part)] == part:
                    hits.setdefault(number, {}).setdefault(k, []).append((at, at + len(part) - 1))
        found, taken = [], set()
        for number, places in hits.items():
            parts = len(self.entries[number][0])
            if parts == 1 or len(places) < parts:
                continue
            chains: dict[int, list[tuple[int, int]]] = {}
            for first in places.get(0, ()):
                chain = [first]
                for k in range(1, parts):
                    after = next((h for h in places[k] if h[0] > chain[-1][1]), None)
                    if after is None:
                        break
                    chain.append(after)
                else:
                    chains[chain[1][0]] = chain  # later beginnings replace earlier ones
            for chain in chains.values():
                found.append((chain[0][0], chain[-1][1], number))
                taken.update(i for a, b in chain[1:] for i in range(a, b + 1))
        found += [(a, b, number) for number, places in hits.items() if len(self.entries[number][0]) == 1 for a, b in places[0] if a not in taken]
        best: dict[int, tuple[int, int, int]] = {}
        for hit in sorted(found, key=lambda h: (h[0], -h[1], -len(self.entries[h[2]][0]), " ... ".join(self.entries[h[2]][0]))):
            best.setdefault(hit[0], hit)
        out, covered = [], -1
        for hit in best.values():
            if hit[0] > covered:
                out.append(hit)
            if len(self.entries[hit[2]][0]) == 1:
                covered = max(covered, hit[1])
        return out


def connective_matcher(lexicon: DataFrame) -> ConnectiveMatcher:
    """The matcher of a lexicon (orth, type, rel), whose size is checked."""
    rows = lexicon.select("orth", "type", "rel").where("size(orth) > 0").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} connectives")
    return ConnectiveMatcher([([p.lower() for p in r["orth"]], r["type"], list(r["rel"] or [])) for r in rows])


def find_connectives(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, sent_id, first_idx, last_idx, orth, type, rel): connectives in the sentences, one pass over gathered sentences."""
    matcher = connective_matcher(lexicon)
    rows = tokens.where(F.col("form").isNotNull()).groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.lower("form").alias("form")))).alias("tokens"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, sent, toks in zip(batch["doc_id"], batch["sent_id"], batch["tokens"]):
                for first, last, number in matcher.match([t["form"] for t in toks]):
                    orth, kind, rel = matcher.entries[number]
                    out.append((doc, sent, toks[first]["idx"], toks[last]["idx"], orth, kind, rel))
            yield pd.DataFrame(out, columns=["doc_id", "sent_id", "first_idx", "last_idx", "orth", "type", "rel"])

    return rows.mapInPandas(run, "doc_id string, sent_id int, first_idx int, last_idx int, orth array<string>, type string, rel array<string>")


def argument_type(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds sent_initial, para_initial and arg_type: sentence-initial adverbs and conjunctions reach back."""
    first = tokens.where(~F.coalesce(F.col("form"), F.lit("")).rlike(r"^[@#\p{Punct}]")).groupBy("doc_id", "sent_id").agg(F.min("idx").alias("_f"))
    rows = found.join(first, ["doc_id", "sent_id"], "left").withColumn("sent_initial", F.coalesce(F.col("first_idx") <= F.col("_f"), F.lit(False))).withColumn("para_initial", F.col("sent_initial") & (F.col("sent_id") == 0)).drop("_f")
    return rows.withColumn("arg_type", F.when(F.col("type").isin("adv", "conj") & F.col("sent_initial"), "inter_sent").otherwise("intra_sent"))


SCOPE_DDL = "doc_id string, sent_id int, first_idx int, last_idx int, orth array<string>, type string, rel array<string>, arg_type string, int_arg string, ext_arg string"


def scopes_of(found: list[tuple[int, int, str]], units: list[Unit], first_word: int | None, previous: str | None) -> list[tuple[str, str | None, str | None]]:
    """(arg_type, internal, external argument) of each connective (first_idx, last_idx, type) of a sentence.

    Internal is the innermost unit that holds the connective. External is the preceding sentence for
    arguments across sentences; within a sentence the embedding unit, else for a subjunction at the
    beginning the following unit, else the preceding one, else the following one.
    """
    texts = {u.number: " ".join(t["form"] for t in u.tokens) for u in units}
    spans = [(min(t["idx"] for t in u.tokens), u.number, max(t["idx"] for t in u.tokens), u) for u in units]
    out = []
    for first, _, kind in found:
        initial = first_word is not None and first <= first_word
        across = kind in ("adv", "conj") and initial
        inside = [s for s in spans if s[0] <= first <= s[2]]
        own = max(inside, key=lambda s: s[:2])[3] if inside else None
        if across:
            outer = previous
        else:
            at = own.number if own else None
            later = min((n for n in texts if at is not None and n > at), default=None)
            earlier = max((n for n in texts if at is not None and n < at), default=None)
            order = [own.parent if own else None, later if kind == "subj" and initial else None, earlier, later]
            outer = texts.get(next((n for n in order if n is not None), None))
        out.append(("inter_sent" if across else "intra_sent", texts[own.number] if own else None, outer))
    return out


def gathered_sentences(words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tokens): the tokens of each sentence in order, the first delivered of each position.

    One shuffle by document, which the sentences and a window over them keep.
    """
    at = F.col("tok_id") if "tok_id" in words.columns else F.lit(0)
    item = F.struct(
        "idx", at.alias("at"), F.coalesce("form", F.lit("")).alias("form"), F.coalesce("lemma", "form", F.lit("")).alias("lemma"), F.coalesce("pos", F.lit("XY")).alias("pos"),
        F.coalesce("phead", F.lit(-1)).alias("head"), F.coalesce("feat", F.lit("")).alias("feat"), F.col("form").isNotNull().alias("held"),
    )
    placed = words.select("doc_id", "sent_id", item.alias("item")).repartition("doc_id")
    rows = placed.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list("item")).alias("tokens"))
    once = F.filter("tokens", lambda t, i: (i == 0) | (F.get("tokens", i - 1)["idx"] != t["idx"]))
    return rows.withColumn("tokens", once)


def connective_arguments(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Connectives of each sentence with their type and arguments, in one pass over the gathered sentences.

    Units, connectives and scopes all come from the same sentence; the text of the sentence before it
    is laid beside it by a running window over the document.
    """
    from pyspark.sql import Window as W

    matcher = connective_matcher(lexicon)
    text = F.array_join(F.transform(F.filter("tokens", lambda t: t["held"]), lambda t: t["form"]), " ")
    order = W.partitionBy("doc_id").orderBy("sent_id")
    rows = gathered_sentences(words).withColumn("text", text).withColumn("previous", F.when(F.lag("sent_id").over(order) == F.col("sent_id") - 1, F.lag("text").over(order))).drop("text")

    def run(batches):
        segmenter, odd = UnitSegmenter(), frozenset("@#" + string.punctuation)
        for batch in batches:
            out = []
            for doc, sent, toks, previous in zip(batch["doc_id"], batch["sent_id"], batch["tokens"], batch["previous"]):
                held = [t for t in toks if t["held"]]
                found = matcher.match([t["form"].lower() for t in held])
                if not found:
                    continue
                units = segmenter.segment([dict(t) | {"feats": tuple(t["feat"].replace("|", " ").split())} for t in toks])
                first_word = next((t["idx"] for t in held if t["form"][:1] not in odd), None)
                placed = [(held[a]["idx"], held[b]["idx"], matcher.entries[n][1]) for a, b, n in found]
                for (a, b, kind), (_, _, n), scope in zip(placed, found, scopes_of(placed, units, first_word, previous)):
                    out.append((doc, sent, a, b, matcher.entries[n][0], kind, matcher.entries[n][2], *scope))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCOPE_DDL.split(", ")])

    return rows.mapInPandas(run, SCOPE_DDL)


# --- outputs ---------------------------------------------------------------------------------------------


def segment_offsets(units: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, offsets): left offset of each segment and the right end of the last, in token text."""
    from pyspark.sql import Window as W

    before = W.partitionBy("doc_id").orderBy("sent_id", "idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("form") + 1).over(before), F.lit(0)).cast("int")
    rows = tokens.where(F.col("form").isNotNull()).select("doc_id", "sent_id", "idx", start.alias("start"), F.length("form").alias("_n")).withColumn("end", F.col("start") + F.col("_n")).drop("_n")
    joined = units.select("doc_id", "sent_id", F.col("first_idx").alias("idx")).join(rows, ["doc_id", "sent_id", "idx"])
    lefts = joined.groupBy("doc_id").agg(F.array_sort(F.collect_set("start")).alias("lefts"))
    return lefts.join(rows.groupBy("doc_id").agg(F.max("end").alias("right")), "doc_id").select("doc_id", F.concat("lefts", F.array("right")).alias("offsets"))


def rst_nodes(offsets: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, nid, text): a numbered node per segment with the slice of its source text."""
    pairs = offsets.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "text", F.posexplode(F.arrays_zip(F.slice("offsets", F.lit(1), F.size("offsets") - 1).alias("a"), F.slice("offsets", F.lit(2), F.size("offsets") - 1).alias("b"))).alias("p", "o"))
    return pairs.select("doc_id", (F.col("p") + 1).alias("nid"), F.substring("text", F.col("o.a") + 1, F.col("o.b") - F.col("o.a")).alias("text"))


def source_texts(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) with each id once; a second row of an id raises."""
    rows = texts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("text").alias("text"))
    return rows.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string")))).otherwise(F.lit(True))).where("_ok").select(key, "text")


def unit_layers(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stand-off layers: (doc_id, layer, mark_id, sent_id, first_idx, last_idx) and (doc_id, mark_id, feature, value).

    The parent of an embedded unit is the unit it lies in; sentences are the outer layer.
    """
    mark = lambda kind, number: F.concat(F.lit(f"{kind}_"), F.col("sent_id").cast("string"), F.lit("_"), number.cast("string"))
    eds = units.select("doc_id", F.lit("EDS").alias("layer"), mark("eds", F.col("unit_no")).alias("mark_id"), "sent_id", "first_idx", "last_idx")
    sds = units.groupBy("doc_id", "sent_id").agg(F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx")).select("doc_id", F.lit("SDS").alias("layer"), mark("sds", F.lit(0)).alias("mark_id"), "sent_id", "first_idx", "last_idx")
    kinds = units.select("doc_id", mark("eds", F.col("unit_no")).alias("mark_id"), F.lit("type").alias("feature"), F.col("kind").alias("value"))
    parents = units.where("parent is not null").select("doc_id", mark("eds", F.col("unit_no")).alias("mark_id"), F.lit("parent").alias("feature"), mark("eds", F.col("parent")).alias("value"))
    return eds.unionByName(sds), kinds.unionByName(parents)


def units_of_layers(marks: DataFrame, feats: DataFrame) -> DataFrame:
    """(doc_id, sent_id, unit_no, kind, parent, first_idx, last_idx) back from the layers."""
    number = lambda c: F.element_at(F.split(c, "_"), 3).cast("int")
    pick = lambda f: F.max(F.when(F.col("feature") == f, F.col("value")))
    named = feats.groupBy("doc_id", "mark_id").agg(pick("type").alias("kind"), pick("parent").alias("p"))
    rows = marks.where("layer = 'EDS'").join(named, ["doc_id", "mark_id"])
    return rows.select("doc_id", "sent_id", number(F.col("mark_id")).alias("unit_no"), "kind", number(F.col("p")).alias("parent"), "first_idx", "last_idx")


def units_xml(units: DataFrame) -> DataFrame:
    """(doc_id, xml): ``sds`` per sentence with its ``eds`` units, by sentence."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, rows in zip(batch["doc_id"], batch["units"]):
                parts, sent = [], None
                for r in rows:
                    if r["sent_id"] != sent:
                        parts += (["</sds>"] if sent is not None else []) + [f'<sds id="s{r["sent_id"]}">']
                        sent = r["sent_id"]
                    parent = f' parent="e{int(r["parent"])}"' if r["parent"] is not None and r["parent"] == r["parent"] else ""
                    parts.append(f'<eds id="e{r["unit_no"]}" type={quoteattr(r["kind"])}{parent}>{escape(r["text"])}</eds>')
                out.append((doc, "<discourse>" + "".join(parts) + ("</sds>" if sent is not None else "") + "</discourse>"))
            yield pd.DataFrame(out, columns=["doc_id", "xml"])

    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "unit_no", "kind", "parent", "text"))).alias("units"))
    return rows.mapInPandas(run, "doc_id string, xml string")

