"""Map freely typed values to the entries of a reference list, in SQL only.

Typed values are normalised (case, separators, spellings, articles, quantities, remarks, digits in place of letters) and
compared as strings of letters and digits by the pigeonhole principle: a reference string is cut into k+1 segments,
and a value within k edits holds one of them unchanged at nearly the same place. Values and references are joined on
these positional substrings by equality, checked with ``levenshtein``, and what has no match is told by an anti join.
k is the number of edits that is accepted: a third of the reference string's letters, at least 1 and at most MOST_EDITS.

All comparisons are made by this one join. What differs is which strings of a value meet which of a reference:

=======  ==========================================  =================================  ====================
kind     of a value                                  of a reference                     accepted edits
=======  ==========================================  =================================  ====================
equal    each rotation of its words, their reverse   the whole                          0
near     the same                                    the whole                          k
letters  the same, letters sorted                    the whole, letters sorted          0; unsorted k+1
head     the whole                                   each start, from MIN_PREFIX        0
run      each run of its words                       the words                          0
word     the whole, if it is one word (``loose``)    each word                          0
=======  ==========================================  =================================  ====================

A string that is too long to be within MOST_EDITS of any reference isn't rotated, as no rotation could match; there is
no other bound on the number of words or letters. Typed dimensions are mapped to the list's dimensions by the same
steps first. All steps work on distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from dapple.runtime import written

#: What stands for no value at all, and is no misspelling of one.
NOTHING = ("", "other", "misc", "tbd", "na", "none", "null", "nan", "unknown", "unsure", "not sure", "cant tell", "can t tell", "unclear", "various", "todo", "not visible", "nothing", "test", "dont know", "don t know", "no idea", "see notes", "same", "same as above")
#: Spellings that are one.
SPELLINGS = (("grey", "gray"), ("colour", "color"))
MOST_EDITS = 4
MIN_PREFIX = 3  # a shorter start is no abbreviation
HEAD, DOTLESS, RUN, WORD = 5, 30, 50, 60  # costs beside 10 an edit; a rotation costs 2, a stripped form 1


def accepted(length: str) -> str:
    """The edits that are accepted for a reference string of a length."""
    return f"least({MOST_EDITS}, greatest(1, {length} DIV 3), {length} - 1)"


_LETTERS = "translate({0}, '013457@$', 'oieastas')"
#: Words of letters and digits apart by single spaces.
_WORDS = r"""trim(regexp_replace(regexp_replace({0}, r"['’`]", ''), r'[^\pL\pN@$]+', ' '))"""


def _words(x: str) -> str:
    x = _WORDS.format(x)
    for one, other in SPELLINGS:
        x = f"replace({x}, '{one}', '{other}')"
    return x


_STRIP = (
    (r"\([^)]*\)?\s*$", ""),  # a remark in brackets
    (r"[\s,;-]+(probably|maybe|perhaps|possibly|i think|likely|left side|right side|partly hidden|partially hidden|in part)\W*$", ""),
    (r"[\s,-]+x\s*\d+\W*$", ""),  # x2
    (r"^\W*\d+\s*x[\s-]+", ""),  # 2x
    (r"^\W*(a|an|the|some|one|any)[\s-]+", ""),
)


def _stripped(x: str) -> str:
    x = f"replace({x}, '_', ' ')"
    for pattern, to in _STRIP:
        x = f"regexp_replace({x}, r'{pattern}', '{to}')"
    return x


def _compact(words: str) -> str:
    return _LETTERS.format(f"replace({words}, ' ', '')")


_FORMS = f"""
SELECT value, forms.words AS words, forms.rank AS rank FROM (
  SELECT value, explode(filter(array(
    named_struct('words', {_words("lower(value)")}, 'rank', 0),
    named_struct('words', {_words(_stripped("lower(value)"))}, 'rank', 1)), f -> f.words != '')) AS forms
  FROM (SELECT DISTINCT value FROM {{values}} WHERE value IS NOT NULL))
"""

#: value, rank, form: each rotation of the words of each form, and their reverse; the rank tells how much was changed.
_ROTATED = f"""
SELECT value, min(rank) AS rank, form FROM (
  SELECT value, rank + 2 * least(abs(shift), 1) AS rank,
         {_compact("array_join(CASE WHEN shift < 0 THEN reverse(w) ELSE concat(slice(w, shift + 1, size(w)), slice(w, 1, shift)) END, '')")} AS form
  FROM (SELECT value, rank, w, explode(CASE WHEN size(w) >= 2 AND char_length(words) - size(w) + 1 <= longest + {MOST_EDITS} THEN sequence(-1, size(w) - 1) ELSE array(0) END) AS shift
        FROM (SELECT *, split(words, ' ') AS w, (SELECT coalesce(max(char_length(ref)), 0) FROM {{refs}}) AS longest FROM {{forms}})))
WHERE form != '' GROUP BY value, form
"""

_SORTED = "array_join(array_sort(split({0}, '')), '')"

#: Segments of the references' strings: kind, id, scope, ref (what is cut), own (what is checked), most (accepted edits of own).
_SEGMENTS = f"""
SELECT kind, id, scope, own, most, len, i, substr(ref, start, stop - start) AS segment FROM (
  SELECT *, 1 + i * len DIV (k + 1) AS start, 1 + (i + 1) * len DIV (k + 1) AS stop FROM (
    SELECT *, explode(sequence(0, k)) AS i FROM (SELECT *, CASE kind WHEN 'near' THEN {accepted("len")} ELSE 0 END AS k FROM (SELECT *, char_length(ref) AS len FROM {{refs}}) WHERE len > 0)))
"""

#: Substrings of a string that may equal segment i of a reference string of length n within k edits, by the shift bounds
#: that follow from the edits before and behind the segment.
_PROBES = f"""
SELECT kind, value, rank, own, n, i, substr(form, p, l) AS segment FROM (
  SELECT *, explode(sequence(greatest(1, start - i, start + d - (k - i)), least(len - l + 1, start + i, start + d + (k - i)))) AS p
  FROM (SELECT *, 1 + i * n DIV (k + 1) AS start, (i + 1) * n DIV (k + 1) - i * n DIV (k + 1) AS l, len - n AS d FROM (
    SELECT *, explode(sequence(0, k)) AS i FROM (
      SELECT *, CASE kind WHEN 'near' THEN {accepted("n")} ELSE 0 END AS k FROM (
        SELECT f.*, r.n FROM (SELECT *, char_length(form) AS len, explode(CASE kind WHEN 'near' THEN sequence(greatest(1, char_length(form) - {MOST_EDITS}), char_length(form) + {MOST_EDITS}) ELSE array(char_length(form)) END) AS m FROM {{forms}}) f
        JOIN (SELECT DISTINCT kind AS rkind, char_length(ref) AS n FROM {{refs}}) r ON f.m = r.n AND f.kind = r.rkind))
    WHERE abs(len - n) <= k))
  WHERE l > 0 AND greatest(1, start - i, start + d - (k - i)) <= least(len - l + 1, start + i, start + d + (k - i)))
"""


def pigeonhole(forms: DataFrame, refs: DataFrame) -> DataFrame:
    """``kind``, ``value``, ``rank``, ``id``, ``scope``, ``own``, ``d``: strings of values (``kind``, ``value``, ``rank``, ``form``, ``own``) within the
    accepted edits of strings of references (``kind``, ``id``, ``scope``, ``ref``, ``own``, ``most``) of their kind. A pair that shares
    several segments comes as often; callers take the least cost, so it isn't made distinct."""
    sql = forms.sparkSession.sql
    pairs = sql("""
      SELECT p.kind, p.value, p.rank, p.own AS form, s.id, s.scope, s.own, s.most FROM {probes} p JOIN {segments} s
      ON p.kind = s.kind AND p.n = s.len AND p.i = s.i AND p.segment = s.segment""", probes=sql(_PROBES, forms=forms, refs=refs), segments=sql(_SEGMENTS, refs=refs))  # fmt: skip
    return sql("SELECT kind, value, rank, id, scope, own, d FROM (SELECT *, levenshtein(form, own, most) AS d FROM {pairs}) WHERE d >= 0", pairs=pairs)


def match_values(values: DataFrame, refs: DataFrame, scopes: DataFrame | None = None, loose: bool = False) -> DataFrame:
    """``value``, ``scope``, ``id``: the entry of ``refs`` (``id``, ``scope``, ``words``) that each value means.

    ``scopes`` (``value``, ``scope``) limits a value to entries of a scope; a null scope opens all. Each pair gives one row at
    most. Of several entries the one that is equal in the earliest form counts, then the least cost, then the least id. A
    value that equals an entry of another scope, or says that there is no value, is not taken for a misspelling.
    ``loose`` also takes an entry of which the value is a word.
    """
    spark = values.sparkSession
    sql = spark.sql
    refs = written(sql(f"SELECT DISTINCT id, scope, words, {_compact('words')} AS ref FROM {{refs}} WHERE words != ''", refs=refs), "refs")
    wanted = scopes if scopes is not None else sql("SELECT value, CAST(NULL AS STRING) AS scope FROM {values}", values=values)
    wanted = sql("SELECT DISTINCT value, scope FROM {w} WHERE value IS NOT NULL", w=wanted)
    forms = written(sql(_FORMS, values=wanted), "forms")
    rotated = written(sql(_ROTATED, forms=forms, refs=refs), "rotated")
    nothing = ", ".join("'" + x.replace(" ", "") + "'" for x in NOTHING)
    best = "SELECT value, scope, min_by(id, struct(cost, id)) AS id FROM {found} GROUP BY value, scope"
    in_scope = "JOIN {w} w ON w.value = e.value WHERE w.scope IS NULL OR w.scope = e.scope"

    equal = written(pigeonhole(
        sql("SELECT 'equal' AS kind, value, rank, form, form AS own FROM {rotated}", rotated=rotated), sql("SELECT 'equal' AS kind, id, scope, ref, ref AS own, 0 AS most FROM {refs}", refs=refs),
    ), "equal")
    done = written(sql(best, found=sql("SELECT w.value, w.scope, e.id, e.rank AS cost FROM {e} e " + in_scope, e=equal, w=wanted)), "done")
    rest = written(sql(f"""
      SELECT w.value, w.scope FROM {{wanted}} w LEFT ANTI JOIN {{done}} d ON w.value = d.value AND w.scope <=> d.scope
      LEFT ANTI JOIN (SELECT value FROM {{rotated}} WHERE form IN ({nothing})) n ON n.value = w.value
      LEFT ANTI JOIN (SELECT value FROM {{equal}} WHERE rank < 2) o ON o.value = w.value""", wanted=wanted, done=done, rotated=rotated, equal=equal), "rest")  # fmt: skip

    whole = sql("SELECT f.* FROM {rotated} f LEFT SEMI JOIN {rest} r ON f.value = r.value", rotated=rotated, rest=rest)
    plain = sql("SELECT f.*, split(words, ' ') AS w FROM {forms} f LEFT SEMI JOIN {rest} r ON f.value = r.value", forms=forms, rest=rest)
    of_values = sql(f"""
      SELECT 'near' AS kind, value, rank, form, form AS own FROM {{whole}}
      UNION ALL SELECT 'letters', value, rank, {_SORTED.format("form")}, form FROM {{whole}} WHERE char_length(form) <= (SELECT max(char_length(ref)) FROM {{refs}})
      UNION ALL SELECT 'head', value, rank, {_compact("words")} AS form, {_compact("words")} FROM {{plain}}
      UNION ALL SELECT 'run', value, rank, part, part FROM (SELECT value, rank, explode(transform(filter(flatten(transform(sequence(1, size(w)), a -> transform(sequence(a, least(size(w), a + longest - 1)), b -> struct(a, b)))), s -> s.b - s.a + 1 < size(w)),
          s -> array_join(slice(w, s.a, s.b - s.a + 1), ' '))) AS part FROM (SELECT *, (SELECT coalesce(max(size(split(words, ' '))), 1) FROM {{refs}}) AS longest FROM {{plain}}))
      {"UNION ALL SELECT 'word', value, rank, words, words FROM {plain} WHERE size(w) = 1" if loose else ""}""", whole=whole, plain=plain, refs=refs)  # fmt: skip
    of_refs = sql(f"""
      SELECT 'near' AS kind, id, scope, ref, ref AS own, {accepted("char_length(ref)")} AS most FROM {{refs}}
      UNION ALL SELECT 'letters', id, scope, {_SORTED.format("ref")}, ref, {accepted("char_length(ref)")} + 1 FROM {{refs}}
      UNION ALL SELECT 'head', id, scope, head, head, 0 FROM (SELECT id, scope, explode(transform(sequence({MIN_PREFIX}, char_length(ref) - 1), n -> substr(ref, 1, n))) AS head FROM {{refs}} WHERE char_length(ref) > {MIN_PREFIX})
      UNION ALL SELECT 'run', id, scope, words, words, 0 FROM {{refs}}
      UNION ALL SELECT 'word', id, scope, word, word, 0 FROM (SELECT id, scope, explode(split(words, ' ')) AS word FROM {{refs}})""", refs=refs)  # fmt: skip
    found = pigeonhole(written(of_values, "open-forms"), of_refs)
    cost = f"CASE kind WHEN 'head' THEN {HEAD} + CASE WHEN rtrim(e.value) LIKE '%.' THEN 0 ELSE {DOTLESS} END WHEN 'run' THEN {RUN} + 10 / char_length(replace(e.own, ' ', '')) WHEN 'word' THEN {WORD} ELSE 10 * d END + e.rank"
    close = sql(best, found=sql(f"SELECT w.value, w.scope, e.id, {cost} AS cost FROM {{e}} e " + in_scope, e=found, w=rest))
    return sql("SELECT * FROM {done} UNION ALL SELECT * FROM {close}", done=done, close=close)


def map_entries(entries: DataFrame, reference: DataFrame, entry_id: str = "entry_id") -> DataFrame:
    """``entry_id``, ``dimension`` and ``label`` as typed, ``canonical_id``, ``canonical_label``, ``listed``: one row an entry.

    ``reference`` has ``canonical_id``, ``dimension``, ``label``, ``canonical_label``. An entry listed letter for letter
    has ``listed`` true. Of other entries the dimension is resolved first; a null dimension opens all, one that
    resolves to none opens none. Unmatched entries, those with a null or blank label among them, have
    ``canonical_id`` 0 and no canonical label. Entries sent twice give a row each. Extra columns aren't read.
    """
    sql = entries.sparkSession.sql
    ref = sql("SELECT DISTINCT canonical_id, dimension, label, canonical_label FROM {r} WHERE canonical_id IS NOT NULL AND label IS NOT NULL AND dimension IS NOT NULL", r=reference)
    typed = written(sql(f"SELECT {entry_id} AS entry_id, dimension, label FROM {{e}}", e=entries), "typed")
    pairs = written(sql("SELECT DISTINCT dimension, label FROM {t} WHERE trim(label) != ''", t=typed), "pairs")
    names = sql(f"SELECT dimension AS id, CAST(NULL AS STRING) AS scope, {_words('lower(dimension)')} AS words FROM {{r}} GROUP BY dimension", r=ref)
    dims = written(match_values(sql("SELECT dimension AS value FROM {p}", p=pairs), names, loose=True), "dims")
    scoped = sql("""
      SELECT p.dimension, p.label, d.id AS scope FROM {p} p LEFT JOIN {d} d ON p.dimension = d.value
      WHERE p.dimension IS NULL OR d.id IS NOT NULL""", p=pairs, d=dims)  # fmt: skip
    scoped = written(scoped, "scoped")
    labels = sql(f"SELECT canonical_id AS id, dimension AS scope, {_words('lower(label)')} AS words FROM {{r}}", r=ref)
    found = match_values(sql("SELECT label AS value FROM {s}", s=scoped), labels, sql("SELECT label AS value, scope FROM {s}", s=scoped))
    meant = written(sql("SELECT s.dimension, s.label, f.id FROM {s} s JOIN {f} f ON s.label = f.value AND s.scope <=> f.scope", s=scoped, f=found), "meant")
    missing = sql("SELECT t.* FROM {t} t LEFT ANTI JOIN {m} m ON t.label = m.label AND t.dimension <=> m.dimension", t=typed, m=meant)
    mapped = sql("""
      SELECT t.*, m.id AS canonical_id FROM {t} t JOIN {m} m ON t.label = m.label AND t.dimension <=> m.dimension
      UNION ALL SELECT *, CAST(0 AS BIGINT) FROM {n}""", t=typed, m=meant, n=missing)  # fmt: skip
    return sql("""
      SELECT m.entry_id, m.dimension, m.label, coalesce(l.id, m.canonical_id) AS canonical_id, c.canonical_label, l.id IS NOT NULL AS listed FROM {m} m
      LEFT JOIN (SELECT dimension, label, min(canonical_id) AS id FROM {r} GROUP BY dimension, label) l ON m.dimension = l.dimension AND m.label = l.label
      LEFT JOIN (SELECT canonical_id, min(canonical_label) AS canonical_label FROM {r} GROUP BY canonical_id) c ON c.canonical_id = coalesce(l.id, m.canonical_id)""", m=mapped, r=ref)  # fmt: skip
