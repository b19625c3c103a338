"""Source files -> chunks, symbols, calls, references, tests and diagnostics.

No grammar is at hand, so files are read by a lexer: comments and literals are
blanked out (places stay the same), blocks are found by their headers and
matching braces, and the rest follows from nesting.  That covers the usual
constructs of Rust, C#, JavaScript and TypeScript; it is not a full parser, and
what it cannot balance is a diagnostic, never a failure.

A file gives rows of one tagged schema; ids, resolution and joins are relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.functions import ids, secret_rules

CODE = ("rust", "csharp", "javascript", "typescript")
CONFIG = ("toml", "yaml", "json")
#: Records, and characters of their files, from which on a batch is handed on.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 20
FIELDS = (
    ("record_kind", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("owner", pa.string()), ("text", pa.string()), ("signature", pa.string()),
    ("start_line", pa.int64()), ("end_line", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("confidence", pa.float64()), ("status", pa.string()), ("framework", pa.string()),
)
SCHEMA = "path string, language string, " + ", ".join(f"{n} {({'string': 'string', 'int64': 'bigint', 'double': 'double'})[str(t)]}" for n, t in FIELDS)

# Attributes that mark tests, by framework; confidences by kind.
TEST_ATTRIBUTES = {"nunit": ("Test", "TestCase", "TestCaseSource"), "xunit": ("Fact", "Theory"), "mstest": ("TestMethod", "DataTestMethod")}
CONFIDENCE = {"import": 0.4, "attribute": 0.3, "decorator": 0.3, "implementation": 0.5, "inheritance": 0.5, "type_reference": 0.45}
_KEYWORDS = frozenset("if for while switch match return catch function fn loop in of new await typeof sizeof nameof using lock foreach unsafe else do throw yield case super this constructor".split())
_WORD = r"[A-Za-z_$][\w$]*"
#: Words before a name and its parentheses that are no return type.
_NO_TYPE = frozenset("return new await throw else yield case goto in is as not and or record class struct interface enum delegate".split())


def blank(text: str, language: str) -> str:
    """The text with comments and the insides of literals as spaces."""
    rust = language == "rust"
    shapes = [r"//[^\n]*", r"/\*.*?\*/", r'"(?:\\.|[^"\\])*"']
    if rust:
        shapes = [r'r(#*)".*?"\1', *shapes, r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"]
    elif language == "csharp":
        shapes = [r'@"(?:""|[^"])*"', *shapes, r"'(?:\\.|[^'\\\n])+'"]
    else:
        shapes += [r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"]
    return re.sub("|".join(f"(?:{s})" for s in shapes), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def without_macros(masked: str) -> str:
    """Rust text without the insides of macro definitions and of braced macro
    calls: what stands there are tokens, not items."""
    out, at = [], 0
    for m in re.finditer(rf"\bmacro_rules\s*!\s*{_WORD}\s*\{{|(?<![\w!])(?:{_WORD}::)*{_WORD}!\s*\{{", masked):
        if m.start() < at:
            continue
        end = _closing(masked, m.end() - 1) or len(masked)
        out += [masked[at : m.end()], re.sub(r"[^\n]", " ", masked[m.end() : end - 1])]
        at = end - 1
    return "".join([*out, masked[at:]])


@dataclass
class Block:
    kind: str  # fn, impl, type, mod, class
    name: str
    start: int
    body: int  # where the body begins (equal to end without one)
    end: int
    header: str
    outer: list[Block] = field(default_factory=list)


def _closing(masked: str, at: int) -> int | None:
    """Place after the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return None


def _after_parens(masked: str, at: int) -> int | None:
    depth = 0
    for m in re.compile(r"[()]").finditer(masked, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return None


#: A name that is given a function: a variable, or a field of a class.
_VALUE = rf"\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*(?:{_WORD})?\s*(?=\()|(?:\([^()]*\)(?:\s*:[^=]+?)?|{_WORD})\s*=>)"
_ASSIGNED = rf"(?:(?:export|default|const|let|var)\s+)+({_WORD}){_VALUE}"
_FIELD = rf"(?:(?:public|private|protected|static|readonly|override|declare)\s+)*(#?{_WORD})[?!]?{_VALUE}"
_HEADS = {
    "rust": (("fn", rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default)\s+)*fn\s+({_WORD})"), ("impl", r"\bimpl\b([^{;]*)(?=\{)"), ("type", rf"(?:pub(?:\([^)]*\))?\s+)?\b(?:struct|enum|union|trait|type)\s+({_WORD})"), ("mod", rf"(?:pub(?:\([^)]*\))?\s+)?\bmod\s+({_WORD})\s*(?=\{{)")),
    "csharp": (("class", rf"\b(?:class|struct|interface|record)\s+({_WORD})"), ("mod", r"\bnamespace\s+([\w.]+)"), ("fn", rf"(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|abstract|extern|partial|unsafe|readonly)\s+)*(?:[\w.<>\[\],?]+\s+)?(?<![.\w])({_WORD}|operator\s*\S+)\s*(?:<[^<>()]*>)?\s*(?=\()")),
    "javascript": (("class", rf"\bclass\s+({_WORD})"), ("fn", _ASSIGNED), ("fn", rf"(?:async\s+)?\bfunction\s*\*?\s*({_WORD})\s*(?:<[^()]*>)?\s*(?=\()"), ("fn", _FIELD), ("fn", rf"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*(?<![.\w$])(#?{_WORD})\s*(?:<[^<>()]*>)?\s*(?=\()")),
}
_HEADS["typescript"] = (("class", rf"\binterface\s+({_WORD})"), *_HEADS["javascript"])


def _named_impl(header: str) -> str:
    """Type of an impl block; ``<T as Trait>`` for trait implementations."""
    h = re.sub(r"\bwhere\b.*", "", header, flags=re.S).strip()
    if h.startswith("<"):
        depth = 0
        for k, c in enumerate(h):
            depth += (c == "<") - (c == ">")
            if depth == 0:
                h = h[k + 1 :].strip()
                break
    trait, sep, own = (x.strip() for x in h.partition(" for "))
    return f"<{own} as {trait}>" if sep else trait


def blocks(masked: str, language: str) -> list[Block]:
    """All blocks with their enclosing ones, by start."""
    out: dict[tuple[int, str], Block] = {}
    for kind, pattern in _HEADS[language]:
        for m in re.finditer(pattern, masked):
            name = m[1].strip()
            if kind == "fn":
                if name in _KEYWORDS and name != "constructor":
                    continue
                at = m.end()
                if masked[at : at + 1] == "<":
                    at = masked.find("(", at)
                arrow = m[0].rstrip().endswith("=>")
                if not arrow:
                    at = masked.find("(", at)
                    after = _after_parens(masked, at) if at >= 0 else None
                    if after is None:
                        continue
                    tail = re.compile(r"\s*(?:(?::|->)[^{;=]*|\bwhere\b[^{;]*|:\s*(?:base|this)\([^)]*\))*\s*(\{|=>|;)?").match(masked, after)
                    mark = tail[1] if tail else None
                    plain = re.match(rf"#?{_WORD}\s*\($", m[0] + "(") is not None
                    signature = language == "typescript" and mark == ";"  # kept below in interfaces and when abstract
                    if language in ("javascript", "typescript") and mark != "{" and "function" not in m[0] and not signature:
                        continue
                    if language == "rust" and mark == ";":
                        continue  # a signature without a body is no function item
                    if language == "csharp" and _NO_TYPE & set(re.findall(r"\w+", m[0][: m[0].rindex(name)])):
                        continue
                    if language == "csharp" and (mark is None or (mark == ";" and plain) or (plain and mark != "{" and mark != "=>")):
                        continue
                    if mark is None:
                        continue
                    body = tail.start(1)
                else:
                    body = re.compile(r"\s*").match(masked, at).end()
                    mark = masked[body : body + 1]
                if mark == "{":
                    end = _closing(masked, body) or len(masked)
                elif mark == ";":
                    body = end = body + 1
                else:
                    stop = re.compile(r";|\n\s*\n|$").search(masked, body)
                    end = stop.end()
            else:
                brace = re.compile(r"[{;]").search(masked, m.end())
                if brace is None:
                    continue
                body = brace.start()
                file_scope = language == "csharp" and kind == "mod" and brace[0] == ";"
                end = len(masked) if file_scope else _closing(masked, body) or len(masked) if brace[0] == "{" else brace.end()
                if brace[0] == ";" and not file_scope:
                    body = end
                name = _named_impl(m[1]) if kind == "impl" else name
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            out.setdefault((body, kind), Block(kind, name, start, body, end, masked[start:body]))
    found = sorted(out.values(), key=lambda b: (b.start, -b.end))
    stack: list[Block] = []
    for b in found:
        while stack and stack[-1].end <= b.start:
            stack.pop()
        b.outer = list(stack)
        stack.append(b)
    if language in ("javascript", "typescript"):
        direct = lambda b: bool(b.outer) and b.outer[-1].kind == "class"
        field_ = re.compile(rf"{_FIELD}")
        variable = re.compile(r"(?:export|default|const|let|var)\b")
        kept = []
        for b in found:
            signature = b.kind == "fn" and b.body == b.end and masked[b.end - 1 : b.end] == ";" and "=" not in b.header
            if signature and not (direct(b) and (b.outer[-1].header.lstrip().startswith("interface") or re.match(r"(?:\w+\s+)*abstract\b", b.header))):
                continue
            if b.kind == "fn" and field_.match(b.header) and not variable.match(b.header) and not direct(b):
                continue
            kept.append(b)
        found = kept
    if language in ("javascript", "typescript", "csharp"):
        # a bare ``name(...) {`` is a method only directly in a class
        bare = re.compile(rf"(?:(?:public|private|protected|internal|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*#?{_WORD}\s*(?:<[^<>()]*>)?\s*\(")
        found = [b for b in found if b.kind != "fn" or not bare.match(b.header) or b.header.startswith("async function") or b.header.startswith("function") or (b.outer and b.outer[-1].kind == "class") or (language == "csharp" and re.match(rf"[\w.<>\[\],?]+\s+{_WORD}", b.header) is not None and not b.header.startswith(("return ", "new ", "await ", "throw ", "else ")))]
    return found


class Source:
    """One file and what is found in it."""

    def __init__(self, path: str, language: str, text: str, module: list[str] | None = None):
        self.path, self.language, self.text = path, language, text
        self.masked = blank(text, language) if language in CODE else text
        self.places = None if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.rows: list[dict] = []
        self.module = module if module is not None else [p for p in re.sub(r"\.[^./]+$", "", path).split("/") if p and p not in ("src", "lib", "main", "mod", "index", "Program", "program")]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.lines, at)

    def add(self, record: str, start: int, end: int, **more) -> None:
        to_bytes = lambda k: k if self.places is None else self.places[k]
        last = max(start, end - 1)
        self.rows.append({"record_kind": record, "start_line": self.line(start), "end_line": self.line(last), "start_byte": to_bytes(start), "end_byte": to_bytes(end), **more})

    def qualified(self, b: Block) -> str:
        names = [o.name.replace(".", "::") for o in b.outer if o.kind in ("mod", "impl", "class")]
        root = ["crate"] if self.language == "rust" else []
        return "::".join([*root, *self.module, *names, b.name])

    def parse(self) -> list[dict]:
        if not self.text.strip():
            return []
        if self.language not in CODE:
            self.add("chunk", 0, len(self.text), kind="file_fallback", text=self.text)
            return self.rows
        if self.masked.count("{") != self.masked.count("}"):
            self.add("diagnostic", 0, len(self.text), kind="error", text="unbalanced braces")
        found = blocks(without_macros(self.masked) if self.language == "rust" else self.masked, self.language)
        for b in found:
            self.block(b)
        self.references()
        if self.language in ("javascript", "typescript"):
            self.case_tests(found)
        if not any(r["record_kind"] == "chunk" for r in self.rows):
            self.add("chunk", 0, len(self.text), kind="file_fallback", text=self.text)
        return self.rows

    def block(self, b: Block) -> None:
        whole = self.text[b.start : b.end]
        if b.kind in ("impl", "type") and self.language == "rust":
            self.add("chunk", b.start, b.end, kind="impl_summary" if b.kind == "impl" else "type_definition", name=b.name, text=whole)
        if b.kind != "fn":
            return
        # in Rust all functions below an impl are methods, however deep
        method = any(o.kind in ("impl", "class") for o in (b.outer if self.language == "rust" else b.outer[-1:]))
        kind = "method" if method else "function"
        qualified = self.qualified(b)
        signature = self.text[b.start : b.body].strip().rstrip(";")
        self.add("symbol", b.start, b.end, kind=kind, name=b.name, qualified_name=qualified, signature=signature)
        self.add("chunk", b.start, b.end, kind=kind, name=b.name, owner=qualified, text=whole)
        self.calls(b, qualified)
        self.attribute_test(b, qualified)

    def calls(self, b: Block, caller: str) -> None:
        aliases = self.aliases(b)
        macros: list[tuple[int, int]] = []
        for m in re.compile(rf"((?:{_WORD})(?:(?:::|\.|\?\.)(?:<[^<>()]*>::)?{_WORD})*)(!)?\s*(\(|(?<=!)\[|(?<=!)\{{)").finditer(self.masked, b.body, b.end):
            name, bang = re.sub(r"\s+", "", m[1]), m[2] or ""
            before = self.masked[max(0, m.start() - 12) : m.start()].rstrip()
            if name in _KEYWORDS or re.search(r"\b(?:fn|function|class|struct|enum)$", before) or any(s <= m.start() < e for s, e in macros):
                continue
            if bang:
                end = _after_parens(self.masked, m.end() - 1) if m[3] == "(" else None
                macros.append((m.start(), end or m.end()))
                self.add("diagnostic", m.start(), m.end(), kind="macro", text=f"{name}!", owner=caller)
            head, sep, tail = name.partition("::")
            text = aliases[head] + sep + tail if head in aliases else name
            self.add("call", m.start(), m.end(), text=text + bang, owner=caller)

    def aliases(self, b: Block) -> dict[str, str]:
        """Names that ``use`` lines bring into a Rust function."""
        if self.language != "rust":
            return {}
        outer = [o for o in b.outer if o.kind == "mod"]
        low = outer[-1].body if outer else 0
        out: dict[str, str] = {}
        for m in re.finditer(r"\buse\s+([^;]+);", self.masked[low : b.end]):
            out.update(use_aliases(m[1]))
        return out

    def attribute_test(self, b: Block, qualified: str) -> None:
        lead = re.search(r"((?:\s*(?:#\[[^\]]*\]|\[[^\[\]]*\]))+)\s*$", self.masked[: b.start])
        framework = None
        if lead and self.language == "rust" and re.search(r"#\[\s*(?:\w+::)*test\b", lead[1]):
            framework = "rust_test"
        if lead and self.language == "csharp":
            named = [x.removesuffix("Attribute") for x in re.findall(r"[\[,]\s*(?:\w+\.)*(\w+)", lead[1])]
            framework = next((f for f, marks in TEST_ATTRIBUTES.items() if any(n in marks for n in named)), None)
        if framework:
            self.add("test", b.start, b.end, name=b.name, qualified_name=qualified, owner=qualified, framework=framework)

    def case_tests(self, found: list[Block]) -> None:
        """``it`` and ``test`` calls with a plain title, below their suites."""
        named = re.search(r"""(?:from|require\(|import)\s*\(?\s*['"](@jest/globals|jest|vitest|mocha)['"]""", self.text)
        like = re.search(r"(?:^|/)(?:__tests__|tests?)/|\.(?:test|spec)\.[cm]?[jt]sx?$", self.path)
        if not named and not like:
            return
        framework = named[1].replace("@jest/globals", "jest") if named else "jest"
        title = r"""\s*\(\s*(['"`])((?:\\.|(?!\2).)*)\2"""
        suites = [(m.start(), _after_parens(self.masked, self.masked.index("(", m.start())) or len(self.text), static_string(m[3])) for m in re.finditer(rf"(?<![.\w])describe(\.only|\.skip)?{title}", self.text)]
        for m in re.finditer(rf"(?<![.\w])(?:it|test)(\.only|\.skip|\.concurrent)?{title}\s*(?:,\s*({_WORD})\s*[,)])?", self.text):
            if m[2] == "`" and "${" in m[3] or self.masked[m.start()] == " ":
                continue
            end = _after_parens(self.masked, self.masked.index("(", m.start())) or m.end()
            path = [t for s, e, t in suites if s < m.start() < e] + [static_string(m[3])]
            callback = [b for b in found if b.kind == "fn" and b.name == m[4]]
            owner = self.qualified(callback[0]) if len(callback) == 1 else None
            self.add("test", m.start(), end, name=path[-1], qualified_name="::".join(path), owner=owner, framework=framework)

    def references(self) -> None:
        shapes = {
            "rust": (("import", r"\b(?:pub\s+)?use\s+[^;]+;"), ("attribute", r"#!?\[([^\]]*)\]"), ("implementation", r"\bimpl\b(?:<[^>]*>)?\s*([\w:]+)"), ("type_reference", r"(?:->|(?<!:):(?!:))\s*&?(?:'\w+\s+)?(?:mut\s+)?((?:\w+::)*[A-Z]\w*)")),
            "csharp": (("import", r"(?m)^\s*using\s+(?:static\s+)?[\w.]+\s*;"), ("attribute", r"(?m)^\s*\[\s*([\w.]+)"), ("inheritance", r"\b(?:class|struct|interface|record)\s+\w+(?:<[^>]*>)?\s*:\s*([\w.<>, ]+)")),
        }.get(self.language, (("import", r"""(?m)^\s*import\b[^;\n]*"""), ("decorator", r"(?m)^\s*@([\w.]+)"), ("inheritance", r"\b(?:extends|implements)\s+([\w.]+)"), ("type_reference", r":\s*((?:\w+\.)*[A-Z]\w*)")))
        for kind, pattern in shapes:
            for m in re.finditer(pattern, self.masked):
                text = self.text[m.start() : m.end()] if kind == "import" else m[1]
                self.add("reference", m.start(), m.end(), kind=kind, text=text.strip(), confidence=CONFIDENCE[kind], status="unresolved")
                if kind == "inheritance" and self.language == "csharp":
                    for name in re.findall(r"[\w.]+", text):
                        self.add("reference", m.start(), m.end(), kind="type_reference", text=name, confidence=CONFIDENCE["type_reference"], status="unresolved")


def static_string(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text)


def use_aliases(declaration: str) -> dict[str, str]:
    """alias -> path of a Rust ``use``; one level of groups, ``as`` and ``self``."""
    text = re.sub(r"\s+", " ", declaration).strip()
    prefix, brace, rest = text.partition("{")
    entries = [e.strip() for e in rest.rstrip("} ").split(",")] if brace else [text]
    out = {}
    for entry in entries:
        path, _, alias = entry.partition(" as ")
        full = (prefix.strip() + path.strip()) if brace else path.strip()
        if not entry or full.endswith("*"):
            continue
        full = full.removesuffix("::self") if path.strip() == "self" else full
        out[alias.strip() or full.rpartition("::")[2]] = re.sub(r"\s+", "", full)
    return out


def parse_source(path: str, language: str, text: str) -> list[dict]:
    return Source(path, language, text or "").parse()


def extract(files: DataFrame) -> DataFrame:
    """All records of all files (path, language, content), tagged by kind."""

    def records(held: list[tuple[str, str, dict]]) -> pa.RecordBatch:
        columns = [pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.string())]
        columns += [pa.array([h[2].get(n) for h in held], t) for n, t in FIELDS]
        return pa.RecordBatch.from_arrays(columns, ["path", "language", *(n for n, _ in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = [], 0
        for batch in batches:
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                held += [(path, language, r) for r in parse_source(path, language, text)]
                read += len(text or "")
                if len(held) >= BATCH_ROWS or (held and read >= BATCH_CHARS):
                    yield records(held)
                    held, read = [], 0
        if held:
            yield records(held)

    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)


def facts(records: DataFrame, files: DataFrame, run_id: str, parser_version: str) -> dict[str, DataFrame]:
    """Tables chunks, symbols, calls, symbol_references, tests and diagnostics.

    Ids follow from file, kind, name and place; text only gives hashes.
    """
    stamped = records.join(files.select("path", F.col("id").alias("file_id"), "repository_id"), "path").withColumn("index_run_id", F.lit(run_id)).withColumn("parser_version", F.lit(parser_version))
    of = lambda kind: stamped.where(F.col("record_kind") == kind)
    places = ["start_line", "end_line", "start_byte", "end_byte", "index_run_id", "parser_version"]
    c = F.col
    symbols = of("symbol").withColumn("id", ids.stable_id(c("file_id"), c("kind"), c("qualified_name"), c("start_byte"), F.md5("signature"))).select("id", "file_id", F.lit(None).cast("string").alias("parent_symbol_id"), "name", "qualified_name", "kind", "signature", "path", *places)
    owner = symbols.select("file_id", c("qualified_name").alias("owner"), c("id").alias("owner_id"), c("start_byte").alias("owner_start")).groupBy("file_id", "owner").agg(F.min_by("owner_id", "owner_start").alias("owner_id"))
    with_owner = lambda df: df.join(owner, ["file_id", "owner"], "left")
    chunks = with_owner(of("chunk")).withColumn("text_hash", F.md5("text")).withColumn("id", ids.stable_id(c("file_id"), c("kind"), c("start_byte"), c("end_byte"), c("text_hash"))).select("id", "file_id", c("owner_id").alias("symbol_id"), "kind", "text_hash", secret_rules.exclusion_reason(c("text")).alias("excluded_reason"), *places)
    calls = with_owner(of("call")).select(ids.stable_id(c("owner_id"), c("text"), c("start_byte")).alias("id"), c("owner_id").alias("caller_symbol_id"), c("owner").alias("caller_name"), "file_id", c("text").alias("callee_text"), c("start_line").alias("call_line"), "index_run_id", "parser_version")
    refs = of("reference").select(ids.stable_id(c("file_id"), c("kind"), c("text"), c("start_byte")).alias("id"), "file_id", c("text").alias("reference_text"), c("kind").alias("reference_kind"), c("start_line").alias("line"), "confidence", "start_byte", "end_byte", "end_line", "index_run_id", "parser_version")
    tests = with_owner(of("test")).select(ids.stable_id(c("file_id"), c("qualified_name"), c("start_byte")).alias("id"), "repository_id", "file_id", "path", c("owner_id").alias("symbol_id"), "name", "qualified_name", "framework", "language", *places)
    return {"symbols": symbols, "chunks": chunks, "calls": calls, "symbol_references": refs, "tests": tests, "diagnostics": of("diagnostic").select("file_id", "path", "kind", "text", "owner", *places)}
