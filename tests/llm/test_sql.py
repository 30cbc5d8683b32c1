"""What SQL can express of operators that it can't express as a whole: targets of the mix, counts of the quality rules."""

import os

import duckdb
import pytest

from corvina.llm.queries import op3_mixing, op10_quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Capped sources are those whose cap is lowest by weight: the level is the first, in that order, that the next source's cap reaches.
MIX = rf"""
with d as (select doc_id, source, len({WORDS})::bigint as size from documents),
s as (select source, sum(size)::bigint as n, row_number() over (order by encode(source) nulls last) as i from d group by source),
w as (select *, [3, 1, 2][((i - 1) % 3 + 1)::int] as w, 2.0::double * n as cap from s),
o as (select *, cap / w as level_at, row_number() over (order by cap / w, i) as place from w),
c as (select *, (select 1.5 * sum(n) from s) - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0) as left_over, sum(w) over (order by place rows between current row and unbounded following) as weights from o),
l as (select left_over / weights as level from c where level_at >= left_over / weights order by place limit 1),
t as (select source, n, least(cap, w * coalesce((select level from l), 1e300)) as target from c)
select doc_id, size, n as source_size, target from d join t on d.source is not distinct from t.source
"""

RULES = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
p as (select r, unnest(w) as w, generate_subscripts(w, 1) as i from d),
g as (select a.r, a.i, a.w || chr(31) || b.w || chr(31) || c.w as g from p a join p b on b.r = a.r and b.i = a.i + 1 join p c on c.r = a.r and c.i = a.i + 2),
m as (select g.r, g.i from g join (select r, g from g group by all having count(*) > 1) using (r, g)),
x as (select r, count(distinct i + k) as n from m, (select unnest([0, 1, 2]) as k) group by r),
e as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as e from d)
select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(e) - len(list_distinct(e)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
from d join e using (r) left join x using (r)
"""


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


def test_targets_of_the_mix(spark, db):
    want = sorted(db.sql(MIX).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, r.target) for r in op3_mixing(spark, SF).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert len({round(w[3] / w[2], 6) for w in want if w[2]}) > 2


def test_counts_of_the_quality_rules(spark, db):
    want = db.sql(RULES)
    got = op10_quality(spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
