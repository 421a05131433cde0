"""SQL for the queries that SQL can express, by brute force.

Not among them: token ids and sampled segmentations need the tokenizer files, the classifier is trained, the ring hashes
with a function that the other engine lacks, and packing is one of many good answers; tests hold those against
the libraries and brute-force versions.
"""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, DIGESTS, KNOWN, SPELLINGS, STEM


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quote(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"' ' || replace(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' '"
    for pattern, word in SPELLINGS:
        old, new = (f" {x.replace(' ', '  ')} " for x in (pattern, word))
        if set(pattern) & set("?(["):
            out = f"regexp_replace({out}, {_quote(old)}, {_quote(new.replace('$1', chr(92) + '1'))}, 'g')"
        else:
            out = f"replace({out}, {_quote(old)}, {_quote(new)})"
    return f"trim(replace({out}, '  ', ' '))"


_OP3 = f"""
with known as (select distinct md5({_canonical('t')}) digest, license from (values {', '.join(f'({_quote(t)}, {_quote(i)})' for i, t in KNOWN)}) v(t, license)
 union select digest, license from (values {', '.join(f'({_quote(d)}, {_quote(i)})' for i, d in DIGESTS)}) v(digest, license)),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents),
hits as (select distinct doc_id, license from lines join known on digest = md5({_canonical('line')})
 where regexp_matches(lower(line), {_quote(STEM)})),
listed as (select doc_id, string_agg(license, ',' order by license) line_licenses from hits group by doc_id)
select d.doc_id, md5({_canonical('d.text')}) text_digest, k.license, coalesce(l.line_licenses, '') line_licenses
from documents d left join known k on k.digest = md5({_canonical('d.text')}) left join listed l on l.doc_id = d.doc_id
"""

_COMPONENTS = """both_ways as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b),
least as (select a, min(b) b from reach group by a)"""

_OP7 = f"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
shingles as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
 else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end s from words),
each_one as (select doc_id, unnest(s) g from shingles),
pairs as (select x.doc_id a, y.doc_id b from each_one x join each_one y on y.g = x.g and y.doc_id > x.doc_id
 join shingles p on p.doc_id = x.doc_id join shingles q on q.doc_id = y.doc_id group by 1, 2
 having 100 * count(*) >= 90 * (any_value(len(p.s)) + any_value(len(q.s)) - count(*))),
{_COMPONENTS}
select s.doc_id, len(s.s) n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) component_id from shingles s left join least l on l.a = s.doc_id
"""

_OP8 = """
with fair as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
 where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score from fair q join fair c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank" from scored)
select query_id, "rank", vec_id, score from ranked where "rank" <= 5
"""

_OP9 = """
with cut as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) l from documents),
numbered as (select doc_id, unnest(range(0, len(l))) i, unnest(l) line from cut where text is not null),
kept as (select doc_id, i, trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) line from numbered),
filled as (select doc_id, i, line, row_number() over (partition by doc_id order by i) j, len(line) - len(replace(line, ' ', '')) + 1 n from kept where line <> ''),
runs as (select a.doc_id, a.j, b.j j2, sum(b.n) over (partition by a.doc_id, a.j order by b.j) words, a.n first_words, b.n last_words,
 string_agg(b.line, chr(10)) over (partition by a.doc_id, a.j order by b.j) run from filled a join filled b on b.doc_id = a.doc_id and b.j between a.j and a.j + 49),
shortest as (select * from runs where words >= 50 and (words - first_words < 50 or words - last_words < 50)),
firsts as (select *, min((doc_id, j)) over (partition by run) f from shortest),
gone as (select distinct f.doc_id, l.i from firsts f join filled l on l.doc_id = f.doc_id and l.j between f.j and f.j2 where (f.doc_id, f.j) <> f.f),
listed as (select doc_id, string_agg(i::varchar, ',' order by i) removed_lines from gone group by doc_id),
left_over as (select n.doc_id, string_agg(n.line, chr(10) order by n.i) text from numbered n left join gone g on g.doc_id = n.doc_id and g.i = n.i where g.i is null group by n.doc_id)
select c.doc_id, cast(len(c.l) as integer) n_lines, coalesce(r.removed_lines, '') removed_lines, md5(coalesce(o.text, '')) kept_md5
from cut c left join listed r on r.doc_id = c.doc_id left join left_over o on o.doc_id = c.doc_id
"""

_OP10 = f"""
with recursive fair as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit as (select vec_id, v, sqrt(list_inner_product(v, v)) n from fair),
pairs as (select x.vec_id a, y.vec_id b from unit x join unit y on y.vec_id > x.vec_id and len(y.v) = len(x.v) where list_inner_product(x.v, y.v) / x.n / y.n >= 0.9),
{_COMPONENTS},
counts as (select a, count(*) n from both_ways group by a)
select e.vec_id, coalesce(c.n, 0) n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) kept
from embeddings e left join counts c on c.a = e.vec_id left join least l on l.a = e.vec_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_digests": _OP3,
    "op7_jaccard_fragments": _OP7,
    "op8_va_file_top_k": _OP8,
    "op9_line_runs": _OP9,
    "op10_vector_cells": _OP10,
}
