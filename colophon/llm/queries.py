"""The registered queries of the training-data operators, and SQL for those it can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontaminate import contamination
from .edit_fingerprint import classed_documents
from .filter_audit import audit_filters
from .language import identify_languages
from .licenses import LICENCE_RULES, SENTENCES, anchors, scan_licences
from .manifest import manifest
from .mixing import mix_sources
from .packing import pack_documents
from .quotation import reply_ordered
from .simhash import near_duplicates
from .token_index import round_trip
from .toxicity import judge_toxicity
from .url_filter import ENTITIES, RULES, judge_urls


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer is, on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules and by what its aliases are."""
    return judge_urls(read(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the component of those within 4 bits of each other."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by its nearest labelled examples."""
    return judge_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, in reply order."""
    return reply_ordered(read(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 ids."""
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_file())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, with the spans of mixed texts."""
    return identify_languages(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence rule that a document's sentences meet."""
    return scan_licences(read(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and the next one, and its class."""
    return classed_documents(read(spark, sf_dir, "documents"))


def op10_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as wavelet matrices and read back."""
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_file())


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, the roots above it and its proof; every fifth text is tampered with."""
    return manifest(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes and costs, at every step of every order, by language."""
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all sources takes of every document."""
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_quotation": op4_quotation,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_fingerprint": op9_fingerprint,
    "op10_token_index": op10_token_index,
    "op11_manifest": op11_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_mixing": op13_mixing,
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _url_sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = {r: f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))" for r in rules}
    rule = "case " + " ".join(f"when {fits[r]} then '{r.name}'" for r in rules) + " end"
    action = "case " + " ".join(f"when {fits[r]} then '{r.action}'" for r in rules) + " end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    after = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    found = lambda pattern: f"regexp_extract(tag, '(?is){pattern}', 1)"
    quoted = lambda name: found(rf"""[\s"''/]{name}\s*=\s*["'']([^"'']*)["'']""")
    attribute = lambda name: rf"""case when {quoted(name)} <> '' then {quoted(name)} else {found(rf"""[\s"''/]{name}\s*=\s*([^\s"''>]+)""")} end"""
    decoded = "raw"
    for entity, plain in ENTITIES:
        decoded = f"replace({decoded}, {_text(entity)}, {_text(plain)})"
    return rf"""
    with recursive
    split as (select page_id, url, html, coalesce({after}, '') as rest from pages),
    parts as (
      select page_id, url, html,
             translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
             translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as address
      from split),
    tags as (
      select url, host, path, address, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag
      from parts where regexp_matches(html, '(?i)\b(?:canonical|refresh)\b')),
    targets as (
      select *, trim({decoded}) as target
      from (select *, case
          when regexp_matches(tag, '(?i)^<link\b') and regexp_matches({attribute("rel")}, '(?i)(^|\s)canonical(\s|$)') then {attribute("href")}
          when regexp_matches(tag, '(?i)^<meta\b') and regexp_matches({attribute("http-equiv")}, '(?i)^\s*refresh\s*$') then regexp_extract(tag, '(?is)[\s"'';]url\s*=\s*["'']?([^"''>\s;]+)', 1)
        end as raw from tags)),
    whole as (
      select address as a, case
          when strpos(target, '://') > 0 then target
          when starts_with(target, '//') then 'x:' || target
          when starts_with(target, '/') then 'x://' || host || target
          else 'x://' || host || case when regexp_replace(path, '[^/]*$', '') = '' then '/' else regexp_replace(path, '[^/]*$', '') end || target end as b
      from targets where target <> ''),
    pairs as (
      select a, translate(regexp_extract(substr(b, strpos(b, '://') + 3), '^[^/?#]*'), '{upper}', '{lower}') || regexp_extract(substr(b, strpos(b, '://') + 3), '^[^/?#]*([^#]*)', 1) as b from whole),
    links as (select a, b from pairs where a <> '' and b <> '' and a <> b union select b, a from pairs where a <> '' and b <> '' and a <> b),
    reach as (select a as node, a as seen from links union select r.node, l.b from reach r join links l on r.seen = l.a),
    judged as (
      select node, min(seen) as alias_of, bool_or(coalesce(({action}) = 'block', false)) as inherited
      from (select node, seen, regexp_extract(seen, '^[^/?#]*') as host, regexp_extract(seen, '^[^/?#]*([^?#]*)', 1) as path from reach)
      group by node)
    select page_id, host, path, {rule} as rule,
           coalesce({action}, case when inherited then 'block' else 'allow' end) as verdict,
           alias_of, coalesce(inherited, false) as inherited
    from parts left join judged on node = address"""


def _licence_sql() -> str:
    seen, known = set(), []
    for name, sentence in SENTENCES:
        if sentence not in seen:
            seen.add(sentence)
            known.append((name, sentence))
    anchor = "(?i)" + "|".join(anchors(SENTENCES))
    rows = []
    for r in LICENCE_RULES:
        met = lambda rule: "regexp_matches(sequence, '" + " " + " (?:.* )?".join(rule.steps) + " ')"
        larger = [x for x in LICENCE_RULES if len(x.steps) > len(r.steps) and set(r.steps) <= set(x.steps)]
        where = " and ".join([met(r), *(f"not {met(x)}" for x in larger)])
        at = lambda step, f: f"(select {f}(h.sentence_no) from (select unnest(hits) as h) where h.sentence_id = '{step}')"
        rows.append(
            f"select doc_id, '{r.rule}' as rule, '{r.licence}' as licence, {len(r.steps)}::int as n_steps, "
            f"(select min(n) from (select unnest(firsts) as n)) as first_sentence, (select max(n) from (select unnest(lasts) as n)) as last_sentence "
            f"from (select doc_id, list_transform(list_filter(hits, lambda x: x.sentence_id = '{r.steps[0]}'), lambda x: x.sentence_no) as firsts, "
            f"list_transform(list_filter(hits, lambda x: x.sentence_id = '{r.steps[-1]}'), lambda x: x.sentence_no) as lasts from found where {where})"
        )
    return rf"""
    with known(sentence_id, sentence) as (values {", ".join(f"({_text(a)}, {_text(b)})" for a, b in known)}),
    wholes as (
      select doc_id, md5(text) as text_hash, string_split(regexp_replace(text, '([.!?:;])[ \t\r\n]+|(?:[ \t\r]*\n){{2,}}', '\1' || chr(1), 'g'), chr(1)) as wholes
      from documents where regexp_matches(text, '{anchor}')),
    numbered as (select doc_id, text_hash, generate_subscripts(wholes, 1) - 1 as sentence_no, unnest(wholes) as whole from wholes),
    parts as (
      select doc_id, text_hash, sentence_no, case when regexp_matches(whole, '[\r\n]') then list_concat([whole], regexp_split_to_array(whole, '[\r\n]+')) else [whole] end as parts
      from numbered where regexp_matches(whole, '{anchor}')),
    lines as (select doc_id, text_hash, sentence_no, generate_subscripts(parts, 1) - 1 as line_no, unnest(parts) as part from parts),
    hits as (
      select distinct doc_id, text_hash, sentence_no, line_no, sentence_id
      from lines join known on sentence = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
    found as (
      select doc_id, list({{'sentence_no': sentence_no::int, 'sentence_id': sentence_id}} order by sentence_no, line_no, sentence_id) as hits,
             ' ' || string_agg(sentence_id, ' ' order by sentence_no, line_no, sentence_id) || ' ' as sequence
      from hits group by doc_id, text_hash)
    {" union all ".join(rows)}"""


def _quotation_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    mark = r"'^[ \t]*((?:>[ \t]?)*)'"
    level = f"length(regexp_extract({{0}}, {mark}, 1)) - length(replace(regexp_extract({{0}}, {mark}, 1), '>', ''))"
    normal = r"trim(regexp_replace(" + lower.format("raw") + r", '[ \t\r\n\x0B\f]+', ' ', 'g'))"
    return rf"""
    with recursive
    cut as (select conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') as lines from conversations),
    bare as (select conv_id, turn, list_transform(lines, lambda x: {level.format("x")}) as levels, list_transform(lines, lambda x: regexp_replace(x, {mark}, '')) as bare
             from cut where conv_id is not null and turn is not null),
    joined as (
      select *, array_to_string(list_transform(range(1, len(bare) + 1), lambda i: case when i = 1 or levels[i - 1] <> levels[i] or trim(bare[i - 1], ' ') = '' then chr(1) || levels[i] || chr(2) else ' ' end || bare[i]), '') as whole from bare),
    pieces as (
      select conv_id, turn, unnest(levels) as level, unnest(bare) as raw from bare
      union all select conv_id, turn, cast(split_part(piece, chr(2), 1) as int), split_part(piece, chr(2), 2) from (select conv_id, turn, unnest(list_filter(string_split(whole, chr(1)), lambda x: x <> '')) as piece from joined)),
    passages as (select distinct conv_id, turn, level, sha256({normal}) as passage from pieces where {normal} <> ''),
    origins as (select conv_id, level, passage, min(turn) as origin from passages group by all),
    votes as (
      select p.conv_id, p.turn, p.level, o.origin, count(*) as passages
      from passages p join origins o on p.conv_id = o.conv_id and p.level - 1 = o.level and p.passage = o.passage
      where p.level > 0 and o.origin < p.turn group by all),
    links as (
      select conv_id, turn, origin as parent_turn
      from (select *, row_number() over (partition by conv_id, turn order by level, passages desc, origin desc) as n from votes) where n = 1),
    chains as (
      select conv_id, turn, parent_turn as up, 1 as depth from links
      union all select c.conv_id, c.turn, l.parent_turn, c.depth + 1 from chains c join links l on c.conv_id = l.conv_id and c.up = l.turn),
    threads as (select conv_id, turn, min(up) as thread_turn, max(depth) as depth from chains group by all)
    select c.conv_id, coalesce(t.thread_turn, c.turn) as thread_turn, c.turn, c.role, l.parent_turn, coalesce(t.depth, 0) as depth,
           len(list_filter(lines, lambda x: {level.format("x")} > 0)) as n_quoted_lines,
           list_max(list_transform(lines, lambda x: {level.format("x")})) as max_level,
           trim(array_to_string(list_filter(lines, lambda x: {level.format("x")} = 0), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as text
    from cut c left join links l on c.conv_id = l.conv_id and c.turn = l.turn
               left join threads t on c.conv_id = t.conv_id and c.turn = t.turn"""


def _manifest_sql(levels: int = 8) -> str:
    """One step a level, for trees of up to 16 ** ``levels`` leaves."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc32_sql("cast(doc_id as varchar)")

    def tree(name: str, last: str) -> tuple[str, str]:
        """Levels of the trees of ``{name}0`` (tree, i, h), and the siblings of a node at each step up."""
        steps = []
        for k in range(levels):
            steps.append(f"{name}n{k} as (select tree, count(*) as n from {name}{k} group by tree)")
            steps.append(f"{name}{k + 1} as (select l.tree, i // 16 as i, sha256(string_agg(h, '' order by i)) as h from {name}{k} l join {name}n{k} c on l.tree is not distinct from c.tree where n > 1 group by l.tree, i // 16)")
            steps.append(f"{name}s{k} as (select l.tree, l.i, string_agg(o.h, '' order by o.i) filter (o.i < l.i) as before, string_agg(o.h, '' order by o.i) filter (o.i > l.i) as after from {name}{k} l join {name}n{k} c on l.tree is not distinct from c.tree join {name}{k} o on l.tree is not distinct from o.tree and l.i // 16 = o.i // 16 where n > 1 group by l.tree, l.i)")
        roots = " union all ".join(f"select l.tree, l.h from {name}{k} l join {name}n{k} c on l.tree is not distinct from c.tree where n = 1" for k in range(levels))
        return ", ".join(steps), f"{last} as ({roots})"

    own, own_roots = tree("a", "subroots")
    top, top_roots = tree("b", "roots")
    climbs, at = [], "start"
    for kind, node in (("a", "i"), ("b", "top_i")):
        for k in range(levels):
            name = f"c{kind}{k}"
            key = "s.tree is not distinct from p.source" if kind == "a" else "true"
            climbs.append(
                f"{name} as (select p.* replace (case when s.i is null then p.node else sha256(coalesce(s.before, '') || p.node || coalesce(s.after, '')) end as node, p.proof || coalesce(s.before, '') || coalesce(s.after, '') as proof) "
                f"from {at} p left join {kind}s{k} s on {key} and s.i = p.{node} // {16**k})"
            )
            at = name
    return f"""
    with l as (select doc_id, source, {leaf("text")} as leaf, case when {crc} % 5 = 0 then {leaf(lower)} else {leaf("text")} end as changed from documents),
    placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from l),
    a0 as (select source as tree, i, leaf as h from placed), {own}, {own_roots},
    b0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as i, h from subroots), {top}, {top_roots},
    tops as (select tree as source, h as subroot, row_number() over (order by tree nulls first) - 1 as top_i from subroots),
    start as (select p.*, t.subroot, t.top_i, p.changed as node, '' as proof from placed p join tops t on p.source is not distinct from t.source),
    {", ".join(climbs)}
    select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, node as folded_root, node = h as verified from {at}, roots"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text, digit by digit and bit by bit."""
    step = "case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    eight = "list_reduce(list_prepend(xor(acc, x), range(8)), lambda c, j: " + step + ")"
    digits = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), lambda acc, x: {eight}), 4294967295)"


def _audit_sql() -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return rf"""
    with said as (select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as bad from labels group by doc_id),
    least as (select coalesce(text, '') as t, min(doc_id) as least from documents group by 1),
    masks as (
      select coalesce(lang, '') as part, d.doc_id,
             (len({words}) < 100)::int as fa, (100 * len(list_distinct({words})) < 80 * len({words}))::int as fb,
             (100 * len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) > 10 * length(coalesce(text, '')))::int as fc,
             regexp_matches(coalesce(text, ''), '[#$%&*|]')::int as fd, coalesce(d.doc_id > least, false)::int as fe
      from documents d join least l on coalesce(d.text, '') = l.t),
    counts as (
      select part, {{'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe}} as fails, fa + fb + fc + fd + fe as n_fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(bad, 0)) as bad
      from masks left join said using (doc_id) group by all),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
               where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps as (select filter_order, unnest(range(1, 6)) as step from orders)
    select part, filter_order, step::int as step, filter, sum(n) filter (not gone and not here)::bigint as kept, coalesce(sum(n) filter (not gone and here), 0)::bigint as removed,
           coalesce(sum(n) filter (gone and here), 0)::bigint as redundant, coalesce(sum(n) filter (here and n_fails = 1), 0)::bigint as unique_fails,
           coalesce(sum(good) filter (not gone and here), 0)::bigint as good_lost, coalesce(sum(bad) filter (not gone and here), 0)::bigint as toxic_lost,
           coalesce(sum(n * (120 // nullif(n_fails, 0))) filter (here), 0)::bigint as shapley
    from (select part, filter_order, step, substr(filter_order, step::int, 1) as filter, n, good, bad, n_fails,
                 fails[substr(filter_order, step::int, 1)] = 1 as here,
                 len(list_filter(string_split(substr(filter_order, 1, step::int - 1), ''), lambda x: x <> '' and fails[x] = 1)) > 0 as gone
          from (select part, n, good, bad, n_fails, map {{'A': fails.A, 'B': fails.B, 'C': fails.C, 'D': fails.D, 'E': fails.E}} as fails from counts), steps)
    group by all"""


def _mixing_sql() -> str:
    return r"""
    with drawn as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as size,
             (('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '-') || ':' || coalesce(text, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
      from documents),
    rows as (select *, case when size > 0 then length(bin(size)) else 0 end as class from drawn),
    sizes as (select source, sum(size)::bigint as source_size from rows group by source),
    weighed as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as weight, 3 * source_size as cap from sizes),
    ratios as (select *, cap / weight as ratio from weighed),
    shares as (select *, ((sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
                      / nullif(sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following), 0)::double) as share from ratios),
    targets as (select source, source_size, case when ratio <= share then cap::double else max(case when ratio > share then share end) over () * weight end as target from shares),
    owed as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as copies from targets),
    classes as (select source, class, sum(size)::bigint as words from rows group by all),
    scaled as (
      select c.source, class, words, source_size, target, copies, greatest(target - copies * source_size, 0.0::double) as owes,
             (greatest(target - copies * source_size, 0.0::double) - coalesce(sum(words) over (w rows between unbounded preceding and 1 preceding), 0)::double)
               / nullif(sum(class * words) over (w rows between current row and unbounded following), 0)::double as c
      from classes c join owed o on c.source is not distinct from o.source window w as (partition by c.source order by class desc)),
    chances as (
      select source, class, source_size, target, copies, coalesce(class * c >= 1, false) as sure,
             case when class * c >= 1 then 1 else greatest(max(case when class * c < 1 then c end) over s * class, 0.0::double) end as p,
             owes - coalesce(sum(case when class * c >= 1 then words end) over s, 0)::double as rest
      from scaled window s as (partition by source)),
    ranked as (
      select doc_id, r.source, size, source_size, target, copies, p, rest, case when p > 0 and p < 1 and size > 0 then u * (1 - p) / ((1 - u) * p) end as rank
      from rows r join chances c on r.source is not distinct from c.source and r.class = c.class),
    summed as (select *, coalesce(sum(size) over (partition by source, rank is null order by rank, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0) as before from ranked)
    select doc_id, size, source_size, target, (size * (copies + case when rank is null then (p >= 1)::int else (2 * before + size <= 2 * rest)::int end))::bigint as taken from summed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _url_sql(),
        "op4_quotation": _quotation_sql(),
        "op8_license_scan": _licence_sql(),
        "op11_manifest": _manifest_sql(),
        "op12_filter_audit": _audit_sql(),
        "op13_mixing": _mixing_sql(),
    }
