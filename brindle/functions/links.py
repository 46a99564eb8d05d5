"""Native functions of addresses and links: keys, kinds, hashes, extraction, order of choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import let


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tid(url: Column) -> Column:
    """The number of a thread: in the path after `thread-`, else the whole value of the parameter tid."""
    return F.coalesce(_some(F.regexp_extract(url, r"thread-(\d+)-", 1)), _some(F.regexp_extract(url, r"(?:^|[?&])tid=(\d+)", 1))).try_cast("bigint")


def any_tid(url: Column) -> Column:
    """The first number behind `thread-`, `tid=` or `/t/`."""
    return _some(F.regexp_extract(url, r"(?:thread-|tid=|/t/)(\d+)", 1)).try_cast("bigint")


def board_key(fid: Column, type_id: Column) -> Column:
    """`fid:type`, or `fid` alone where there is no type; null unless the id is a number."""
    whole = F.btrim(fid).rlike(r"^\d+$")
    return F.when(whole, F.concat(F.btrim(fid), F.coalesce(F.concat(F.lit(":"), _some(F.btrim(type_id))), F.lit(""))))


def board_parts(key: Column) -> tuple[Column, Column]:
    return F.coalesce(F.split_part(key, F.lit(":"), F.lit(1)).try_cast("int"), F.lit(0)), F.split_part(key, F.lit(":"), F.lit(2)).try_cast("int")


def link_kind(link: Column, kinds: list[tuple[str, str]], default: str, fold: bool = True) -> Column:
    """The name of the first (LIKE pattern, name) that a link matches; whether case counts is the caller's choice."""
    text = F.coalesce(link, F.lit(""))
    text = F.lower(text) if fold else text
    out = F
    for pattern, name in kinds:
        out = out.when(text.like(pattern), name)
    return out.otherwise(default)


def name_hash(url: Column, name: Column, length: int = 40) -> Column:
    return F.upper(F.substring(F.sha2(F.concat(url, F.lit("\n"), name), 256), 1, length))


def hex_to_base64url(h: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(F.unhex(h)), "+/", "-_"), "=+$", "")


def base64url_to_hex(b: Column) -> Column:
    padded = F.rpad(F.translate(b, "-_", "+/"), (F.ceil(F.length(b) / 4) * 4).cast("int"), F.lit("="))
    return F.hex(F.try_to_binary(padded, F.lit("base64")))


def extension(filename: Column) -> Column:
    """Letters and digits after the last dot of a name with something before it, else null."""
    return _some(F.regexp_extract(F.lower(filename), r"[^/.]\.([a-z0-9]+)$", 1))


def mirrors(url: Column, hosts: list[str]) -> Column:
    """The address on each of some hosts."""
    return F.transform(F.array(*[F.lit(h) for h in hosts]), lambda h: F.concat(F.regexp_extract(url, r"^([a-z]+://)", 1), h, F.regexp_replace(url, r"^[a-z]+://[^/?#]*", "")))


def canonical_thread(url: Column, number: Column, hosts: dict[str, str], paths: list[tuple[str, str]], default: str) -> Column:
    """The one address of a thread, over https: its host by name (mirrors under the main one), its path by a template.

    paths: (regular expression, template with {tid}); the first that an address matches counts, else default. Mobile and www
    prefixes go. A host that isn't listed stays. Without a number an address stays as it is.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z]+://)?([^/?#:@]+)", 1)), r"^(www|m)\.", "")
    known = F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv]) if hosts else None
    main = F.coalesce(known[host], host) if hosts else host
    path = F
    for pattern, template in paths:
        path = path.when(url.rlike(pattern), template)
    path = path.otherwise(default) if paths else F.lit(default)
    return F.when(number.isNull(), url).otherwise(F.concat(F.lit("https://"), main, F.replace(path, F.lit("{tid}"), number.cast("string"))))


def is_private_host(host: Column) -> Column:
    """Loopback, link-local and private IPv4 ranges, and names that only a local network resolves."""
    return host.rlike(r"^(localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+)$|\.(local|internal)$")


def is_allowed(url: Column, hosts: list[str], barred: str | None = None) -> Column:
    """Whether an address over http is of one of some hosts or below one, not private, and has no barred path."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:@]+)", 1))
    listed = F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*(/[^?#]*)", 1)
    return (host != "") & listed & ~is_private_host(host) & (~path.rlike(barred) if barred else F.lit(True))


# Fixed values below: how file links and magnet links are written.


def ed2k_links(text: Column) -> Column:
    """The file links of a text, each once and in order: array of (uri, name, size, hash); sizes over 32 TiB count as 0."""
    uris = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)(ed2k://\|file\|[^|\r\n]+\|\d+\|[0-9a-f]{32}\|)"), F.lit(1)))

    def parts(u: Column) -> Column:
        size = F.split_part(u, F.lit("|"), F.lit(4)).try_cast("bigint")
        return F.struct(u.alias("uri"), F.split_part(u, F.lit("|"), F.lit(3)).alias("name"), F.when(size <= 32 * 1024**4, size).otherwise(0).alias("size"), F.upper(F.split_part(u, F.lit("|"), F.lit(5))).alias("hash"))

    return F.transform(uris, parts)


def magnet_links(text: Column) -> Column:
    """The magnet links of a text, the first of each hash: array of (hash, name, size)."""
    uris = F.regexp_extract_all(text, F.lit(r"(?i)(magnet:\?[^\s\"'<>]*xt=urn:btih:(?:[0-9a-f]{40}|[a-z2-7]{32})[^\s\"'<>]*)"), F.lit(1))

    def parts(u: Column) -> Column:
        name = F.try_url_decode(_some(F.regexp_extract(u, r"[?&]dn=([^&]*)", 1)))
        return F.struct(F.upper(F.regexp_extract(u, r"(?i)btih:([0-9a-z]+)", 1)).alias("hash"), name.alias("name"), F.coalesce(_some(F.regexp_extract(u, r"[?&]xl=(\d+)", 1)).try_cast("bigint"), F.lit(0)).alias("size"))

    return _first_hashes(F.transform(uris, parts))


#: Kinds of files whose names end where a size may be glued to them.
GLUED_KINDS = "mp4 mkv avi wmv ts iso mov flv m4v rmvb mpg mpeg zip rar 7z txt".split()
_INVISIBLE = r"[\x{200B}-\x{200D}\x{FEFF}\x{00AD}]"


def _behind_first(pieces: Column, read: Callable[[Column], Column]) -> Column:
    """What is read in the pieces of a text behind its first mark."""
    return let(pieces, lambda ps: F.transform(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), read))


def broken_file_links(text: Column, kinds: list[str] = GLUED_KINDS, largest: int = 32 * 1024**4) -> Column:
    """The file links of a text however they were damaged, each once and in order: array of (uri, name, size, hash), whole again.

    A link is known by its part `file` alone, so its scheme may lack letters or slashes, or be spaced out. What follows up to
    the next link or an empty line is read as name, size and hash between bars: bars may be full-width or entities,
    line breaks within it are joined, blanks around the parts go. A name of one of `kinds` may have its size and hash
    glued to it. What has no size or no hash of 32 digits is no link. Sizes over `largest` count as 0.
    """
    clear = F.regexp_replace(F.regexp_replace(F.translate(text, "：／．", ":/."), _INVISIBLE, ""), r"(?i)&vert;|&#0*124;|&#x0*7c;", "|")
    begin = r"(?i)(?:(?<![a-z0-9])(?:e\s*d\s*2\s*k|d2k|e2k|edk|ed2)\s*:[\s/]*[|｜]?|[|｜])\s*file\s*(?=[|｜])"
    pieces = F.split(clear, begin)
    ends = rf"(?i)^(.*\.(?:{'|'.join(kinds)}))(\d{{3,}})([0-9a-f]{{32}})/?$"

    def read(piece: Column) -> Column:
        block = F.regexp_replace(F.regexp_replace(piece, r"(?s)\n[ \t\r]*\n.*$", ""), r"[ \t\r]*\n[ \t\r]*", "")
        bars = lambda b: F.split(F.when(F.left(b, F.lit(1)) == "｜", F.translate(b, "|｜", " |")).otherwise(b), r"\|")
        part = lambda fields, i: F.btrim(F.coalesce(F.get(fields, F.lit(i)), F.lit("")))
        return let(let(block, bars), lambda fields: let(F.struct(*[part(fields, i).alias(f"p{i}") for i in (1, 2, 3)]), whole_or_glued))

    def whole_or_glued(p: Column) -> Column:
        glued = lambda i: F.regexp_extract(p["p1"], ends, i)
        whole = p["p2"].rlike(r"^\d+$") & p["p3"].rlike(r"(?i)^[0-9a-f]{32}$") & (p["p1"] != "")
        link = lambda name, size, hash_: F.struct(name.alias("name"), size.alias("size"), F.upper(hash_).alias("hash"))
        return F.when(whole, link(p["p1"], p["p2"], p["p3"])).otherwise(link(glued(1), glued(2), glued(3)))

    found = F.filter(_behind_first(pieces, read), lambda x: x["hash"] != "")

    def built(x: Column) -> Column:
        size = x["size"].try_cast("bigint")
        return F.struct(F.concat(F.lit("ed2k://|file|"), x["name"], F.lit("|"), x["size"], F.lit("|"), x["hash"], F.lit("|/")).alias("uri"), x["name"].alias("name"), F.when(size <= largest, size).otherwise(0).alias("size"), x["hash"].alias("hash"))

    return F.array_distinct(F.transform(found, built))


def broken_magnets(text: Column) -> Column:
    """The magnet links of a text however they were damaged, the first of each hash: array of (hash, name).

    A link is known by its part `btih`. The hash is what follows, 40 hexadecimal or 32 other digits; where it is cut by blanks,
    line breaks or invisible signs it is put together. A name follows it, up to the next parameter or blank.
    """
    clear = F.regexp_replace(F.regexp_replace(F.translate(text, "：＆＝", ":&="), _INVISIBLE, ""), r"(?i)&amp;", "&")
    pieces = F.split(clear, r"(?i)\bb\s*t\s*i\s*h\s*:\s*")

    def read(piece: Column) -> Column:
        direct = F.regexp_extract(piece, r"(?i)^([0-9a-f]{40}|[a-z2-7]{32}|[0-9a-f]{32})(?![0-9a-z])", 1)
        joined = F.regexp_extract(F.regexp_replace(F.left(piece, F.lit(160)), r"\s+", ""), r"(?i)^([0-9a-f]{40})", 1)
        return F.struct(F.upper(F.coalesce(_some(direct), joined)).alias("hash"), F.try_url_decode(_some(F.regexp_extract(piece, r"(?i)^[0-9a-z\s]*(?:&[^&\s]*)*?&\s*dn\s*=\s*([^&\s]*)", 1))).alias("name"))

    return _first_hashes(F.filter(_behind_first(pieces, read), lambda x: x["hash"] != ""))


def _first_hashes(found: Column) -> Column:
    """Links with the first of each hash only."""
    return let(found, lambda fs: let(F.transform(fs, lambda x: x["hash"]), lambda hashes: F.filter(fs, lambda x, i: F.array_position(hashes, x["hash"]) == i + 1)))


def primary(links: Column, archive: str = r"(?i)\.(zip|rar|7z)(\.\d{3})?$") -> Column:
    """The main one of an array of links (name, size): the largest archive, else the largest, else the first."""
    ranked = F.transform(links, lambda x, i: F.struct((~x["name"].rlike(archive)).alias("a"), (-x["size"]).alias("s"), i.alias("i"), x.alias("x")))
    return F.get(F.array_sort(ranked), F.lit(0))["x"]


def primary_of(kinds: dict[str, Column], order: list[str], shared: str | None = None) -> Column:
    """(kind, name) of the main link among several kinds: each kind's own main one, then the first kind in an order that has any.

    kinds: arrays of (name, size), or of (id, password) for the one named by `shared`, of which one with a password comes first.
    """
    def main(kind: str) -> Column:
        if kind != shared:
            return primary(kinds[kind])["name"]
        return F.coalesce(F.get(F.filter(kinds[kind], lambda x: x["password"] != ""), F.lit(0)), F.get(kinds[kind], F.lit(0)))["id"]

    return F.coalesce(*[F.when(F.size(kinds[k]) > 0, F.struct(F.lit(k).alias("kind"), main(k).alias("name"))) for k in order if k in kinds])


def codes(text: Column, prefix: str) -> Column:
    """The distinct codes of a prefix, dash and number in a text, in order and in upper case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(text), F.lit(rf"(?<![A-Z0-9])({prefix.upper()}-?[0-9]{{2,6}})(?![0-9])"), F.lit(1)), lambda c: F.regexp_replace(c, "^([A-Z]+)-?", "$1-")))


def by_host(images: Column, hosts: list[str], n: int) -> Column:
    """The first n images in the order of their hosts in a list, others last, each in its own order."""
    host = lambda u: F.array_position(F.array(*[F.lit(h) for h in hosts]), F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1))
    ranked = F.array_sort(F.transform(F.array_distinct(images), lambda u, i: F.struct(F.when(host(u) > 0, host(u)).otherwise(len(hosts) + 1).alias("h"), i.alias("i"), u.alias("u"))))
    return F.slice(F.transform(ranked, lambda x: x["u"]), 1, n)


def attribute_urls(html: Column, attribute: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'(?i)\s{attribute}\s*=\s*"([^"]*)"'), F.lit(1)))


def share_hash(kind: str, host: Column, id_: Column, length: int = 32) -> Column:
    """The stable hash of something shared at a host."""
    return F.upper(F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), host, F.lit("/"), id_), 256), 1, length))


def names_hash(link: Column, hash_: Column) -> Column:
    """Whether a link holds a hash, whatever its case."""
    return F.coalesce(F.lower(link).contains(F.lower(hash_)) & (hash_ != ""), F.lit(False))


def public_links(links: Column, public: tuple[str, ...], hash_: Column | None = None) -> Column:
    """The links that match one of some LIKE patterns, trimmed and each once, in order; those of a hash come first."""
    trimmed = F.array_distinct(F.transform(links, lambda x: F.btrim(x)))
    kept = F.filter(trimmed, lambda x: link_kind(x, [(p, "y") for p in public], "") == "y")
    if hash_ is None:
        return kept
    return F.concat(F.filter(kept, lambda x: names_hash(x, hash_)), F.filter(kept, lambda x: ~names_hash(x, hash_)))


def uri_key(uri: Column) -> Column:
    """An address for comparing: decoded where it can be, without white space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri), r"\s+", ""))


def encoded_path(path: Column) -> Column:
    """A path with each of its parts percent-encoded."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def moved_hosts(urls: Column, host: str, pattern: str) -> Column:
    """Addresses with what a pattern matches replaced by a host over https, each once and in order."""
    return F.array_distinct(F.transform(urls, lambda u: F.regexp_replace(u, pattern, f"https://{host}")))
