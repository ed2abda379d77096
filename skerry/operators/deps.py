"""Dependencies: manifests to packages, packages to vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import severity, versions

#: Rows up to which a side is broadcast: advisories are a curated list, but their number is checked all the same.
SMALL = 100_000
MANIFESTS = ("package.json", "go.mod", "requirements.txt", "Gemfile", "Gemfile.lock", "Cargo.toml", "Cargo.lock", "composer.json", "composer.lock", "pom.xml")
SKIPPED = (".git", "node_modules", ".next", "__pycache__", ".cache", "vendor")


def _base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def manifests(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (path, content) that are manifests outside of skipped folders."""
    skipped = "|".join(x.replace(".", r"\.") for x in SKIPPED)
    return files.where(_base(F.col("path")).isin(*MANIFESTS) & ~F.col("path").rlike(f"(^|/)({skipped})/"))


def _of(files: DataFrame, name: str) -> DataFrame:
    return files.where(_base(F.col("path")) == name)


def _package(name: Column, version: Column, eco: str, source: str) -> list[Column]:
    return [name.alias("name"), version.alias("version"), F.lit(eco).alias("ecosystem"), F.lit(source).alias("source"), F.col("path")]


def _maps(files: DataFrame, *fields: str) -> DataFrame:
    """(path, k, v) of JSON objects of strings in the content."""
    parsed = files.select("path", F.from_json("content", ", ".join(f"`{f}` map<string,string>" for f in fields)).alias("j"))
    out = None
    for f in fields:
        part = parsed.select("path", F.explode(f"j.`{f}`").alias("k", "v"))
        out = part if out is None else out.unionByName(part)
    return out


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "raw")).select("path", "n", F.regexp_replace("raw", "\r", "").alias("raw"), F.trim(F.regexp_replace("raw", "[\r\t]", " ")).alias("line"))


def _running(marker: Column) -> Column:
    return F.last(marker, ignorenulls=True).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def npm(files: DataFrame) -> DataFrame:
    m = _maps(_of(files, "package.json"), "dependencies", "devDependencies")
    return m.select(*_package(F.col("k"), versions.bare(F.col("v")), "npm", "package.json"))


def composer(files: DataFrame) -> DataFrame:
    m = _maps(_of(files, "composer.json"), "require", "require-dev").where("k <> 'php' and k <> 'ext-*'")
    lock = _of(files, "composer.lock").select("path", F.explode(F.from_json("content", "packages array<struct<name:string,version:string>>")["packages"]).alias("p"))
    return m.select(*_package(F.col("k"), versions.bare(F.col("v")), "Packagist", "composer.json")).unionByName(lock.select(*_package(F.col("p.name"), versions.bare(F.col("p.version")), "Packagist", "composer.lock")))


def go(files: DataFrame) -> DataFrame:
    """Requirements of go.mod, single lines and blocks; local paths and the language itself left out."""
    lines = _lines(_of(files, "go.mod")).withColumn("line", F.trim(F.regexp_replace("line", "//.*$", "")))
    inside = _running(F.when(F.col("line").rlike(r"^require\s*\("), F.lit(True)).when(F.col("line").startswith(")"), F.lit(False)))
    found = lines.withColumn("inside", F.coalesce(inside, F.lit(False)))
    entry = F.when(F.col("line").rlike(r"^require\s+[^(\s]"), F.regexp_replace("line", r"^require\s+", "")).when(F.col("inside") & ~F.col("line").rlike("^require|^$"), F.col("line"))
    parts = found.withColumn("e", F.split(entry, r"\s+")).where(F.size("e") >= 2)
    name, version = F.col("e")[0], F.regexp_replace(F.col("e")[1], r"\+incompatible$", "")
    return parts.where(~name.rlike(r"^\.\.?/") & (name != "go")).select(*_package(name, version, "Go", ""))


def pypi(files: DataFrame) -> DataFrame:
    r = r"^([A-Za-z0-9_.-]+)\s*(?:[=<>!~]=|[<>])\s*([^\s,;#]+)"
    lines = _lines(_of(files, "requirements.txt")).where(F.col("line").rlike(r) & ~F.col("line").rlike("^[#-]"))
    return lines.select(*_package(F.regexp_extract("line", r, 1), F.regexp_extract("line", r, 2), "PyPI", "requirements.txt"))


def rubygems(files: DataFrame) -> DataFrame:
    r = r"^gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]*)['\"])?"
    gems = _lines(_of(files, "Gemfile")).where(F.col("line").rlike(r)).select(*_package(F.regexp_extract("line", r, 1), versions.bare(F.regexp_extract("line", r, 2)), "RubyGems", "Gemfile"))
    lock = _lines(_of(files, "Gemfile.lock"))
    state = _running(F.when(F.col("line").isin("GEM", "GIT", "PATH"), F.col("line")).when(F.col("line").isin("PLATFORMS", "DEPENDENCIES", "BUNDLED WITH"), F.lit("")))
    spec = r"^ {4}([^\s(]+) \(([^)]+)\)"
    locked = lock.withColumn("state", state).where((F.col("state") == "GEM") & F.col("raw").rlike(spec))
    return gems.unionByName(locked.select(*_package(F.regexp_extract("raw", spec, 1), F.regexp_extract("raw", spec, 2), "RubyGems", "Gemfile.lock")))


def crates(files: DataFrame) -> DataFrame:
    toml = _lines(_of(files, "Cargo.toml"))
    section = _running(F.when(F.col("line").rlike(r"^\["), F.col("line")))
    r = r"^([A-Za-z0-9_-]+)\s*=\s*(.+)$"
    deps = toml.withColumn("s", section).where(F.col("s").isin("[dependencies]", "[dev-dependencies]", "[build-dependencies]") & F.col("line").rlike(r) & ~F.col("line").rlike(r"^[#\[]"))
    rest = F.regexp_extract("line", r, 2)
    version = F.when(rest.startswith("{"), F.regexp_extract(rest, r"version\s*=\s*[\"']([^\"']+)", 1)).otherwise(F.regexp_extract(rest, r"^[\"']([^\"']*)", 1))
    out = deps.select(*_package(F.regexp_extract("line", r, 1), versions.bare(version), "crates.io", "Cargo.toml")).where("version <> ''")
    lock = _lines(_of(files, "Cargo.lock")).withColumn("g", F.sum(F.when(F.col("line") == "[[package]]", 1).otherwise(0)).over(Window.partitionBy("path").orderBy("n")))
    kv = r'^(name|version)\s*=\s*"([^"]*)"'
    fields = lock.where((F.col("g") > 0) & F.col("line").rlike(kv)).select("path", "g", "n", F.regexp_extract("line", kv, 1).alias("k"), F.regexp_extract("line", kv, 2).alias("v"))
    record = fields.groupBy("path", "g").agg(F.max_by(F.when(F.col("k") == "name", F.col("v")), F.when(F.col("k") == "name", F.col("n"))).alias("a"), F.max_by(F.when(F.col("k") == "version", F.col("v")), F.when(F.col("k") == "version", F.col("n"))).alias("b"))
    return out.unionByName(record.where("a is not null and b is not null").select(*_package(F.col("a"), F.col("b"), "crates.io", "Cargo.lock")))


def maven(files: DataFrame) -> DataFrame:
    """Dependencies of the first dependencies block, ``${...}`` versions from the properties; test and provided ones out."""
    pom = _of(files, "pom.xml").select("path", "content", F.regexp_extract("content", r"(?s)<dependencies>(.*?)</dependencies>", 1).alias("block"), F.regexp_extract("content", r"(?s)<properties>(.*?)</properties>", 1).alias("props"))
    pairs = lambda i: F.regexp_extract_all("props", F.lit(r"(?s)<([A-Za-z0-9_.-]+)>\s*([^<]*?)\s*</"), i)
    rows = pom.select("path", F.map_from_arrays(F.array_distinct(pairs(1)), F.slice(pairs(2), 1, F.size(F.array_distinct(pairs(1))))).alias("props"), F.explode(F.regexp_extract_all("block", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("d"))
    tag = lambda t: F.trim(F.regexp_extract("d", rf"(?s)<{t}>(.*?)</{t}>", 1))
    raw = tag("version")
    named = F.try_element_at("props", F.regexp_extract(raw, r"^\$\{(.+)\}$", 1))
    ok = rows.where(~tag("scope").isin("test", "provided") & (tag("groupId") != "") & (tag("artifactId") != ""))
    return ok.select(*_package(F.concat_ws(":", tag("groupId"), tag("artifactId")), F.coalesce(named, raw), "Maven", "pom.xml"))


#: By the manifest's name; a format is added by adding to this.
PARSERS = {"package.json": npm, "composer.json": composer, "composer.lock": composer, "go.mod": go, "requirements.txt": pypi, "Gemfile": rubygems, "Gemfile.lock": rubygems, "Cargo.toml": crates, "Cargo.lock": crates, "pom.xml": maven}


def packages(files: DataFrame) -> DataFrame:
    """(name, version, ecosystem, source, path) of all manifests in ``files``; those that do not parse give no rows."""
    kept, out = manifests(files), None
    for parse in dict.fromkeys(PARSERS.values()):
        part = parse(kept)
        out = part if out is None else out.unionByName(part)
    return out


def ecosystem(files: DataFrame, group: str = "dir") -> DataFrame:
    """(dir, ecosystem, file): the first lock file present, else the first manifest, in a fixed order."""
    locks = [*((n, "npm") for n in ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")), ("Cargo.lock", "crates.io"), ("Gemfile.lock", "RubyGems"), ("composer.lock", "Packagist")]
    order = locks + list(zip(("package.json", "go.mod", "requirements.txt", "Cargo.toml", "Gemfile", "composer.json", "pom.xml"), ("npm", "Go", "PyPI", "crates.io", "RubyGems", "Packagist", "Maven"), strict=True))
    dim = files.sparkSession.createDataFrame([(n, e, i) for i, (n, e) in enumerate(order)], "file string, ecosystem string, rank int")
    at = files.select(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias(group), _base(F.col("path")).alias("file"))
    return at.join(F.broadcast(dim), "file").groupBy(group).agg(F.min_by("ecosystem", "rank").alias("ecosystem"), F.min_by("file", "rank").alias("file"))


def lookup(pkgs: DataFrame, advisories: DataFrame, exact: bool = False) -> DataFrame:
    """Vulnerabilities of distinct packages: the advisory's name opens the package's, the version is before its fix.

    An advisory list of at most ``SMALL`` rows is broadcast.  A longer one is joined by whole names with each opening
    of a package's name, so no key is common to many names.
    """
    p = pkgs.select("name", "version", "ecosystem").where("version <> ''").distinct().withColumn("vk", versions.key(F.col("version")))
    a = advisories.where("fixed_in <> ''").select("id", "package_name", F.col("ecosystem").alias("eco"), "severity", "summary", "fixed_in", versions.key(F.col("fixed_in")).alias("fk"))
    named = F.col("name") == F.col("package_name") if exact else F.col("name").startswith(F.col("package_name"))
    fits = named & ((F.col("eco") == F.col("ecosystem")) | (F.col("eco") == "") | (F.col("ecosystem") == "")) & (F.col("vk") < F.col("fk"))
    if exact:
        hits = p.join(a, fits)
    elif a.limit(SMALL + 1).count() <= SMALL:
        hits = p.join(F.broadcast(a), fits)
    else:
        keyed = p.withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring("name", F.lit(1), n))))
        hits = keyed.join(a, (F.col("k") == F.col("package_name")) & fits)
    return hits.select("id", F.array().cast("array<string>").alias("aliases"), "summary", F.col("severity").cast("int").alias("severity"), F.col("fixed_in").alias("fixed_version"), F.col("name").alias("affected_package"), F.col("version").alias("affected_version"), "ecosystem", F.lit("advisory-db").alias("source"))


def osv(pkgs: DataFrame, dump: DataFrame) -> DataFrame:
    """Vulnerabilities from an OSV dump (ecosystem, name, version, id, aliases, summary, stated, scores, fixes), by key.

    The last non-empty fix of a row is its fixed version.
    """
    p = pkgs.select("name", "version", "ecosystem").where("version <> ''").distinct()
    fixed = F.coalesce(F.try_element_at(F.filter("fixes", lambda x: x != ""), F.lit(-1)), F.lit(""))
    return p.join(dump, ["ecosystem", "name", "version"]).select("id", "aliases", "summary", severity.of_advisory(F.col("stated"), F.col("scores")).cast("int").alias("severity"), fixed.alias("fixed_version"), F.col("name").alias("affected_package"), F.col("version").alias("affected_version"), "ecosystem", F.lit("osv").alias("source"))


def dedup(vulns: DataFrame) -> DataFrame:
    """One row per (id, package, version): the advisory list's before OSV's."""
    w = Window.partitionBy("id", "affected_package", "affected_version").orderBy(F.when(F.col("source") == "advisory-db", 0).otherwise(1), "summary")
    return vulns.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def at_least(vulns: DataFrame, rank: int) -> DataFrame:
    return vulns.where(F.col("severity") >= rank) if rank else vulns


def vulnerabilities(pkgs: DataFrame, advisories: DataFrame, dump: DataFrame | None = None, min_severity: int = 0) -> DataFrame:
    found = lookup(pkgs, advisories)
    return at_least(dedup(found.unionByName(osv(pkgs, dump)) if dump is not None else found), min_severity)


def orphans(vulns: DataFrame, pkgs: DataFrame) -> DataFrame:
    """Vulnerabilities of no package with a version."""
    named = pkgs.where("version <> ''").select(F.col("name").alias("affected_package")).distinct()
    return vulns.join(named, "affected_package", "left_anti")
