"""DuckDB SQL for every query that SQL can express, written step by step and apart from Spark."""

from __future__ import annotations

from mektup.config import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

MAILS = """
mails AS (
  SELECT doc_id AS mail_id, lang AS category, split_part(text, chr(10), 1) AS subject,
         nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS body
  FROM documents)"""

CLEAN = MAILS + rf""",
complete AS (
  SELECT *, subject || ' ' || body AS text_raw FROM mails
  WHERE category IS NOT NULL AND subject IS NOT NULL AND body IS NOT NULL),
c1 AS (SELECT *, replace(lower(translate(text_raw, 'İI', 'iı')), 'i̇', 'i') AS x FROM complete),
c2 AS (SELECT * REPLACE (regexp_replace(x, 'https?://[a-zA-Z!$-_]+', ' ', 'g') AS x) FROM c1),
c3 AS (SELECT * REPLACE (regexp_replace(x, '\S+@\S+', ' ', 'g') AS x) FROM c2),
c4 AS (SELECT * REPLACE (regexp_replace(x, '\p{{Nd}}+', ' ', 'g') AS x) FROM c3),
c5 AS (SELECT * REPLACE (replace(regexp_replace(x, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '_', ' ') AS x) FROM c4),
c6 AS (SELECT * REPLACE (regexp_replace(x, '\s+', ' ', 'g') AS x) FROM c5),
c7 AS (SELECT * EXCLUDE (x), trim(array_to_string(list_filter(string_split(x, ' '),
         lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), ' ')) AS text_clean FROM c6),
clean AS (SELECT * FROM c7 WHERE text_clean <> '' AND len(string_split(text_clean, ' ')) >= 3)"""


MEASURED = CLEAN + r""",
measured AS (
  SELECT mail_id, category,
    len(regexp_extract_all(text_raw, '\S+')) AS words,
    length(text_raw) AS chars,
    len(regexp_extract_all(text_raw, '[.!?]+')) + 1 AS sentences,
    len(regexp_extract_all(text_raw, '\p{Lu}')) AS uppercase,
    len(regexp_extract_all(text_raw, '!')) AS exclamations,
    len(regexp_extract_all(text_raw, '\?')) AS questions,
    coalesce(length(regexp_replace(text_raw, '\s+', '', 'g')) / nullif(len(regexp_extract_all(text_raw, '\S+')), 0), 0.0)
      AS mean_word_length
  FROM clean)"""

WORD_TERMS = """,
toks AS (SELECT mail_id, list_filter(string_split(text_clean, ' '), lambda w: length(w) >= 2) AS t FROM clean),
word_terms AS (
  SELECT mail_id, 'w' AS kind, term, count(*) AS tf FROM (
    SELECT mail_id, array_to_string(t[i:i + n - 1], ' ') AS term
    FROM (SELECT mail_id, t, n, unnest(range(1, len(t) - n + 2)) AS i
          FROM toks, (SELECT unnest([1, 2, 3]) AS n)))
  GROUP BY ALL)"""

CHAR_TERMS = """,
word_counts AS (
  SELECT mail_id, w, count(*) AS c
  FROM (SELECT mail_id, unnest(string_split(text_clean, ' ')) AS w FROM clean) GROUP BY ALL),
char_terms AS (
  SELECT mail_id, 'c' AS kind, term, sum(c)::BIGINT AS tf FROM (
    SELECT mail_id, c, substr(' ' || w || ' ', i, n) AS term
    FROM (SELECT mail_id, w, c, n, unnest(range(1, greatest(length(w) + 2 - n + 1, 1) + 1)) AS i
          FROM word_counts, (SELECT unnest([3, 4, 5]) AS n)
          WHERE n = 3 OR n <= length(w) + 2))
  GROUP BY ALL)"""

_VOCAB = """,
terms AS ({terms}),
n_docs AS (SELECT count(*) AS n FROM clean),
stats AS (SELECT kind, term, sum(tf)::BIGINT AS cf, count(*) AS df FROM terms GROUP BY ALL),
ranked AS (
  SELECT kind, term, cf, df, n, row_number() OVER (PARTITION BY kind ORDER BY cf DESC, term) AS r
  FROM stats, n_docs WHERE df >= 2 AND df <= 0.95 * n),
vocab AS (
  SELECT kind, term, row_number() OVER (ORDER BY kind DESC, term) - 1 AS feature_index, cf, df,
         ln((1 + n) / (1 + df)) + 1 AS idf
  FROM ranked WHERE r <= CASE WHEN kind = 'w' THEN 12000 ELSE 8000 END)"""

WORD_VOCAB = WORD_TERMS + _VOCAB.format(terms="SELECT * FROM word_terms")
DUAL_VOCAB = WORD_TERMS + CHAR_TERMS + _VOCAB.format(
    terms="SELECT * FROM word_terms UNION ALL SELECT * FROM char_terms"
)

WEIGHTS = """,
raw_weights AS (
  SELECT mail_id, kind, feature_index, (1 + ln(tf)) * idf AS w FROM terms JOIN vocab USING (kind, term)),
weights AS (
  SELECT mail_id, kind, feature_index, w / sqrt(sum(w * w) OVER (PARTITION BY mail_id, kind)) AS weight
  FROM raw_weights)"""

RULES = CLEAN + r""",
ruled AS (
  SELECT mail_id, category,
    CASE WHEN regexp_matches(text_clean, '[ñíó]') THEN 'es' WHEN regexp_matches(text_clean, '[ßäöü]') THEN 'de'
         WHEN regexp_matches(text_clean, '[èêçé]') THEN 'fr' ELSE 'en' END AS by_letters,
    CASE WHEN regexp_matches(text_clean, '[èêçé]') THEN 'fr' ELSE 'en' END AS french_only,
    CASE WHEN regexp_matches(text_clean, '(^| )(der|die|und)( |$)') THEN 'de'
         WHEN regexp_matches(text_clean, '(^| )(los|las|que)( |$)') THEN 'es' ELSE 'xx' END AS by_words
  FROM clean),
pairs AS (SELECT category AS truth, by_letters AS prediction, count(*) AS n FROM ruled GROUP BY ALL)"""


def _class_scores(pairs: str, name: str) -> str:
    return f""",
{name} AS (
  SELECT label, hits / CASE WHEN predicted = 0 THEN 1 ELSE predicted END AS precision,
         hits / CASE WHEN support = 0 THEN 1 ELSE support END AS recall,
         2 * hits / (predicted + support) AS f1, support, hits
  FROM (SELECT label,
          coalesce((SELECT sum(n) FROM {pairs} p WHERE p.truth = label), 0)::DOUBLE AS support,
          coalesce((SELECT sum(n) FROM {pairs} p WHERE p.prediction = label), 0)::DOUBLE AS predicted,
          coalesce((SELECT sum(n) FROM {pairs} p WHERE p.truth = label AND p.prediction = label), 0)::DOUBLE AS hits
        FROM (SELECT truth AS label FROM {pairs} UNION SELECT prediction FROM {pairs})))"""


SCORES = RULES + _class_scores("pairs", "cls")

MODELS = (
    RULES
    + """,
pairs_f AS (SELECT category AS truth, french_only AS prediction, count(*) AS n FROM ruled GROUP BY ALL),
pairs_w AS (SELECT category AS truth, by_words AS prediction, count(*) AS n FROM ruled GROUP BY ALL)"""
    + _class_scores("pairs", "cls")
    + _class_scores("pairs_f", "cls_f")
    + _class_scores("pairs_w", "cls_w")
    + """,
summary AS ("""
    + " UNION ALL ".join(
        f"""SELECT {i} AS ord, '{name}' AS model, round(sum(hits) / sum(support), 9) AS accuracy,
  round(avg(f1), 9) AS f1_macro, round(avg(precision), 9) AS precision_macro, round(avg(recall), 9) AS recall_macro
  FROM {table}"""
        for i, (name, table) in enumerate(
            [("french_only", "cls_f"), ("by_letters", "cls"), ("by_words", "cls_w")]
        )
    )
    + ")"
)

DENSE = """,
labels AS (SELECT truth AS label FROM pairs UNION SELECT prediction FROM pairs),
dense AS (
  SELECT a.label AS truth, b.label AS prediction, coalesce(p.n, 0) AS n
  FROM labels a CROSS JOIN labels b LEFT JOIN pairs p ON p.truth = a.label AND p.prediction = b.label)"""

QUOTA = MAILS + """,
dim AS (SELECT * FROM (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3), ('it', 4)) AS d(category, ord)),
counts AS (
  SELECT d.category, d.ord, count(m.category) AS n FROM dim d LEFT JOIN mails m ON m.category = d.category
  GROUP BY ALL),
needy AS (
  SELECT category, ord, n, 150 - n AS gap FROM counts WHERE n < 150)"""

PROBS = """
scored AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e
  FROM embeddings),
probs AS (
  SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM scored),
ranked AS (
  SELECT vec_id, p, i - 1 AS cls, p[i] AS probability,
         row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS r
  FROM (SELECT vec_id, p, unnest(range(1, len(p) + 1)) AS i FROM probs)),
best AS (
  SELECT vec_id, 'class' || lpad(cls::VARCHAR, 2, '0') AS prediction, probability AS confidence
  FROM ranked WHERE r = 1)"""

# CRC-32 of a text's bytes, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))),
  lambda i: ('0x' || hex(array_slice(encode({0}), i + 1, i + 1)))::BIGINT)), lambda a, b: list_reduce(
  [xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT)"""

_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# Packed texts that decode to ten characters or fewer are kept as they arrived.
_DECODED = (
    "CASE WHEN doc_id % 4 = 1 AND (length(to_base64(encode(text))) <= 20 OR length("
    + _TRIMMED.format("text")
    + ") <= 10) THEN to_base64(encode(text)) WHEN doc_id % 4 = 2 AND length("
    + _TRIMMED.format("text")
    + r""") <= 10 THEN replace('--===============0042==~Content-Type: text/plain; charset="utf-8"~MIME-Version: 1.0~'
       || 'Content-Transfer-Encoding: base64~~', '~', chr(13) || chr(10)) || to_base64(encode(text))
       || replace('~~--===============0042==--', '~', chr(13) || chr(10)) ELSE """
    + _TRIMMED.format("text")
    + " END"
)

BLOCK_TEXT = r"""
responses AS (
  SELECT conv_id * 1000 + turn AS response_id, role AS category,
    '1. **Başlık:** "' || role || ' ' || turn || '"' || chr(10) || '**İçerik:** ' || text || chr(10) || chr(10) ||
    '2. Başlık: ' || conv_id || chr(10) || 'İçerik: ' || text || chr(10) || 'Kategori: ' || role AS text
  FROM conversations),
lines AS (
  SELECT response_id, category, pos, regexp_replace(string_split(text, chr(10))[pos], '^\s+|\s+$', '', 'g') AS l
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM responses)),
kinds AS (
  SELECT *, replace(l, '**', '') AS c,
    CASE WHEN l = '' THEN 'blank' WHEN contains(l, 'Başlık') AND contains(l, ':') THEN 'subject'
         WHEN contains(l, 'İçerik') AND contains(l, ':') THEN 'body'
         WHEN regexp_matches(l, '^\p{Nd}+\.') OR contains(l, 'Kategori') THEN 'stop' ELSE 'text' END AS kind
  FROM lines),
vals AS (
  SELECT *, nullif(trim(trim(regexp_replace(substr(c, instr(c, ':') + 1), '^\s+|\s+$', '', 'g'), '"'), ''''), '') AS v,
    sum((kind = 'subject')::INT) OVER (PARTITION BY response_id ORDER BY pos) AS rec
  FROM kinds),
seg AS (
  SELECT *, sum((kind IN ('body', 'blank', 'stop'))::INT) OVER (PARTITION BY response_id, rec ORDER BY pos) AS part
  FROM vals WHERE rec > 0)"""


KEYED = """,
keyed AS (
  SELECT mail_id, category, md5('42:' || mail_id) AS k, count(*) OVER (PARTITION BY category) AS nc,
         count(*) OVER () AS n, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || mail_id), mail_id) AS r
  FROM clean)"""

QUOTAS = """,
exact_quota AS (
  SELECT category, nc, n, nc * (n - ceil(0.2 * n)) / n AS exact FROM keyed GROUP BY ALL),
shares AS (
  SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, category)
    <= (n - ceil(0.2 * n)) - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS train FROM exact_quota),
parts AS (
  SELECT mail_id, k.category, CASE WHEN r <= train THEN 'train' ELSE 'test' END AS split
  FROM keyed k JOIN shares s USING (category))"""

SPLIT = KEYED + QUOTAS

# Naive Bayes with smoothed priors on both blocks, learnt from the exact training part.
_ALL_TEXTS = "(SELECT * FROM c7 WHERE text_clean <> '')"
_TRAIN = "(SELECT mail_id FROM parts WHERE split = 'train')"


def bayes_sql(mails: str) -> str:
    """CTEs up to picked (mail_id, category, p, r): the class probabilities of every mail, the likeliest first."""
    clean = CLEAN.replace(MAILS, mails).replace(
        "subject || ' ' || body AS text_raw", "coalesce(subject, '') || ' ' || coalesce(body, '') AS text_raw"
    )
    asked = "\n  WHERE category IS NOT NULL AND subject IS NOT NULL AND body IS NOT NULL"
    clean = clean.replace(asked, "").replace("FROM c7 WHERE text_clean <> ''", "FROM c7" + asked + " AND text_clean <> ''")
    vocab = _VOCAB.format(terms="SELECT * FROM every_term WHERE mail_id IN " + _TRAIN).replace("FROM clean", "FROM " + _TRAIN)
    return (
        clean
        + SPLIT
        + (WORD_TERMS + CHAR_TERMS).replace("FROM clean", "FROM " + _ALL_TEXTS)
        + ", every_term AS (SELECT * FROM word_terms UNION ALL SELECT * FROM char_terms)"
        + vocab
        + WEIGHTS.replace("FROM terms", "FROM every_term")
        + f""",
counts AS (SELECT category, count(*) AS nc, sum(count(*)) OVER () AS n, count(*) OVER () AS k
  FROM clean WHERE mail_id IN {_TRAIN} GROUP BY category),
fc AS (SELECT category, feature_index, sum(weight) AS fc FROM weights JOIN clean USING (mail_id)
  WHERE mail_id IN {_TRAIN} GROUP BY ALL),
cc AS (SELECT category, sum(fc) AS cc FROM fc GROUP BY ALL),
grid AS (
  SELECT co.category, v.feature_index, ln(coalesce(fc.fc, 0) + 0.1) - ln(cc.cc + 0.1 * (SELECT count(*) FROM vocab)) AS lp
  FROM counts co CROSS JOIN vocab v JOIN cc ON cc.category = co.category
  LEFT JOIN fc ON fc.category = co.category AND fc.feature_index = v.feature_index),
sums AS (SELECT mail_id, category, sum(weight * lp) AS s FROM weights JOIN grid USING (feature_index) GROUP BY ALL),
scored AS (
  SELECT m.mail_id, co.category, ln(nc + 0.1) - ln(n + 0.1 * k) + coalesce(s, 0) AS score
  FROM c7 m CROSS JOIN counts co LEFT JOIN sums ON sums.mail_id = m.mail_id AND sums.category = co.category),
raised AS (SELECT mail_id, category, exp(score - max(score) OVER (PARTITION BY mail_id)) AS e FROM scored),
shares_of AS (SELECT mail_id, category, e / sum(e) OVER (PARTITION BY mail_id) AS p FROM raised),
picked AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY p DESC, category) AS r FROM shares_of)"""
    )


# The stream's messages, decoded and filled in, next to the mails that the model learns from.
MESSAGES = (
    MAILS.replace("mails AS", "own AS")
    + ",\nread AS (SELECT doc_id AS mail_id, "
    + _TRIMMED.format("split_part(text, chr(10), 1)")
    + " AS subject, "
    + _DECODED
    + """ AS body FROM documents),
filled AS (
  SELECT mail_id, CASE WHEN subject = '' THEN 'Test' ELSE subject END AS subject,
    CASE WHEN body = '' THEN subject ELSE body END AS body FROM read WHERE subject <> '' OR body <> ''),
mails AS (SELECT * FROM own UNION ALL SELECT mail_id + 1000000000000, NULL, subject, body FROM filled)"""
)

REPORT = """, acc AS (SELECT sum(hits) / sum(support) AS a, sum(support) AS s FROM cls)
          SELECT row_number() OVER (ORDER BY label) - 1 AS ord, label, round(precision, 9) AS precision,
            round(recall, 9) AS recall, round(f1, 9) AS f1, round(support, 9) AS support FROM cls
          UNION ALL SELECT (SELECT count(*) FROM cls), 'accuracy', round(a, 9), round(a, 9), round(a, 9), round(a, 9) FROM acc
          UNION ALL SELECT (SELECT count(*) FROM cls) + 1, 'macro avg', round(avg(precision), 9), round(avg(recall), 9),
            round(avg(f1), 9), sum(support) FROM cls
          UNION ALL SELECT (SELECT count(*) FROM cls) + 2, 'weighted avg', round(sum(precision * support) / sum(support), 9),
            round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support) FROM cls"""


def oracle_sql() -> dict[str, str]:
    with_ = "WITH "
    split = CLEAN + KEYED
    sql = {
        "clean_text": with_ + CLEAN + " SELECT mail_id, category, text_clean FROM clean",
        "category_counts": with_ + CLEAN + " SELECT category, count(*) AS n FROM clean GROUP BY ALL",
        "dataset_summary": with_
        + CLEAN
        + """ SELECT (SELECT count(*) FROM mails) AS rows_in, count(*) AS rows_clean,
          count(DISTINCT category) AS categories, 7 AS metrics FROM clean""",
        "labels": with_ + MAILS + " SELECT DISTINCT category FROM mails",
        "mail_metrics": with_
        + MEASURED
        + """ SELECT * REPLACE (round(mean_word_length, 9) AS mean_word_length) FROM measured""",
        "scaled_metrics": with_
        + MEASURED
        + " SELECT mail_id, "
        + ", ".join(
            f"round(({m} - avg({m}) OVER ()) / CASE WHEN stddev_pop({m}) OVER () = 0 THEN 1 ELSE stddev_pop({m}) OVER () END, 6) AS {m}"
            for m in ("words", "chars", "sentences", "uppercase", "exclamations", "questions", "mean_word_length")
        )
        + " FROM measured",
        "dedupe_keep_first": with_
        + MAILS
        + """ SELECT mail_id, category, subject, body FROM mails
          QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY mail_id) = 1""",
        "append_merge": with_
        + MAILS
        + """ SELECT mail_id, category, subject, body FROM mails
          QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY mail_id % 2, mail_id) = 1""",
        "listed_counts": with_ + QUOTA + " SELECT category, ord, n FROM counts",
        "category_quota": with_
        + QUOTA
        + " SELECT category, ord, n, gap, least(100, gap) AS to_produce FROM needy",
        "confusable_neighbours": with_
        + RULES
        + """ SELECT truth AS category, prediction AS other FROM pairs WHERE truth <> prediction
          UNION ALL SELECT prediction, truth FROM pairs WHERE truth <> prediction""",
        "focus_filter": with_
        + QUOTA
        + RULES.replace(MAILS, "", 1)
        + """, mixed AS (SELECT truth AS c FROM pairs WHERE truth <> prediction
                         UNION SELECT prediction FROM pairs WHERE truth <> prediction)
          SELECT category, gap FROM needy WHERE category IN (SELECT c FROM mixed)
             OR NOT EXISTS (SELECT 1 FROM needy WHERE category IN (SELECT c FROM mixed))""",
        "keyword_audit": with_
        + MAILS
        + """, hints AS (SELECT * FROM (VALUES ('en','include','the'),('en','include','and'),('en','avoid','ou'),
            ('de','include','der'),('de','include','und'),('de','avoid','ß'),('fr','include','le '),
            ('fr','include','de '),('fr','avoid','é'),('es','include','los'),('es','avoid','ñ')) AS h(category, kind, phrase)),
          hits AS (SELECT m.mail_id, m.category,
            count(*) FILTER (kind = 'include' AND contains(text, phrase)) AS include_hits,
            count(*) FILTER (kind = 'avoid' AND contains(text, phrase)) AS avoid_hits, count(phrase) = 0 AS free
            FROM (SELECT mail_id, category, replace(lower(translate(concat_ws(' ', subject, body), 'İI', 'iı')), 'i̇', 'i') AS text
              FROM mails) m LEFT JOIN hints h ON h.category = m.category GROUP BY m.mail_id, m.category)
          SELECT mail_id, category, include_hits, avoid_hits, (free OR include_hits >= 2) AND avoid_hits = 0 AS passes FROM hits""",
        "word_ngrams": with_
        + CLEAN
        + WORD_TERMS
        + " SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM word_terms GROUP BY term",
        "char_ngrams": with_
        + CLEAN
        + WORD_TERMS
        + CHAR_TERMS
        + " SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM char_terms GROUP BY term",
        "vocabulary": with_
        + CLEAN
        + DUAL_VOCAB
        + " SELECT kind, term, feature_index, cf, df, round(idf, 9) AS idf FROM vocab",
        "feature_names": with_
        + CLEAN
        + DUAL_VOCAB
        + " SELECT feature_index, kind || ':' || term AS feature FROM vocab",
        "tfidf_word": with_
        + CLEAN
        + WORD_VOCAB
        + WEIGHTS
        + " SELECT mail_id, feature_index, round(weight, 6) AS weight FROM weights",
        "tfidf_dual": with_
        + CLEAN
        + DUAL_VOCAB
        + WEIGHTS
        + """ SELECT mail_id, count(*) AS n_features, round(sum(weight), 5) AS weight_sum,
          round(sum(weight * feature_index), 3) AS index_sum, round(max(weight), 6) AS weight_max
          FROM weights GROUP BY mail_id""",
        "stratified_split": with_
        + split
        + QUOTAS + " SELECT mail_id, category, split FROM parts",
        "kfold": with_
        + split
        + """ SELECT mail_id, category, CASE WHEN r <= nc // 3 + (nc % 3 > 0)::INT THEN 0
            WHEN r <= 2 * (nc // 3) + (nc % 3 > 0)::INT + (nc % 3 > 1)::INT THEN 1 ELSE 2 END AS fold FROM keyed""",
        "class_weights": with_
        + CLEAN
        + """ SELECT category, count(*) AS n,
          round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM clean GROUP BY category""",
        "confusion_long": with_ + RULES + DENSE + " SELECT truth, prediction, n FROM dense",
        "confusion_norm": with_
        + RULES
        + DENSE
        + """ SELECT truth, prediction, round(CASE WHEN sum(n) OVER (PARTITION BY truth) = 0 THEN 0
          ELSE n / sum(n) OVER (PARTITION BY truth) END, 9) AS share FROM dense""",
        "confusion_pivot": with_
        + RULES
        + DENSE
        + " SELECT truth, "
        + ", ".join(f"sum(n) FILTER (prediction = '{x}')::BIGINT AS {x}" for x in ("de", "en", "es", "fr"))
        + " FROM dense GROUP BY truth",
        "confused_pairs": with_
        + RULES
        + """ SELECT truth, prediction, n, round(n / sum(n) OVER (PARTITION BY truth), 9) AS rate FROM pairs
          QUALIFY truth <> prediction ORDER BY n DESC, truth, prediction LIMIT 10""",
        "classification_report": with_
        + SCORES
        + REPORT,
        "macro_scores": with_
        + SCORES
        + """ SELECT round(sum(hits) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS f1_macro,
          round(avg(precision), 9) AS precision_macro, round(avg(recall), 9) AS recall_macro FROM cls""",
        "class_f1_rank": with_ + SCORES + " SELECT label, round(f1, 9) AS f1 FROM cls",
        "model_summary": with_ + MODELS + " SELECT * FROM summary",
        "best_model": with_ + MODELS + " SELECT * FROM summary ORDER BY f1_macro DESC, ord LIMIT 1",
        "expectation_check": with_
        + PROBS
        + """, t AS (SELECT vec_id, r, 'class' || lpad(cls::VARCHAR, 2, '0') AS label,
            round(probability, 6)::DECIMAL(9, 6)::VARCHAR AS probability FROM ranked WHERE r <= 3)
          SELECT e.vec_id, 'class' || lpad(e.label::VARCHAR, 2, '0') AS expected, b.prediction,
            b.prediction = 'class' || lpad(e.label::VARCHAR, 2, '0') AS hit,
            string_agg(t.label || ':' || t.probability, ' ' ORDER BY r) AS runners_up
          FROM embeddings e JOIN best b USING (vec_id) JOIN t ON t.vec_id = e.vec_id AND r > 1 GROUP BY ALL""",
        "nb_relational": with_
        + CLEAN
        + WORD_VOCAB
        + WEIGHTS
        + """, counts AS (SELECT category, count(*) AS nc, sum(count(*)) OVER () AS n FROM clean GROUP BY category),
          nf AS (SELECT count(*) AS f FROM vocab),
          fc AS (SELECT c.category, feature_index, sum(weight) AS fc FROM weights JOIN clean c USING (mail_id) GROUP BY ALL),
          cc AS (SELECT category, sum(fc) AS cc FROM fc GROUP BY ALL),
          grid AS (SELECT co.category, v.feature_index, ln(coalesce(fc.fc, 0) + 0.1) - ln(cc.cc + 0.1 * nf.f) AS lp
            FROM counts co CROSS JOIN vocab v JOIN cc ON cc.category = co.category CROSS JOIN nf
            LEFT JOIN fc ON fc.category = co.category AND fc.feature_index = v.feature_index),
          sums AS (SELECT w.mail_id, g.category, sum(w.weight * g.lp) AS s FROM weights w JOIN grid g USING (feature_index) GROUP BY ALL)
          SELECT m.mail_id, co.category, round(ln(co.nc / co.n) + coalesce(s, 0), 4) AS score
          FROM clean m CROSS JOIN counts co LEFT JOIN sums ON sums.mail_id = m.mail_id AND sums.category = co.category""",
        "softmax_scores": with_
        + PROBS
        + " SELECT vec_id, cls, round(probability, 9) AS probability FROM ranked",
        "top3_classes": with_
        + PROBS
        + """, t AS (SELECT vec_id, r, 'class' || lpad(cls::VARCHAR, 2, '0') AS label, probability FROM ranked WHERE r <= 3)
          SELECT vec_id, r AS rank, label, round(probability, 9) AS probability,
            round(probability / sum(probability) OVER (PARTITION BY vec_id), 9) AS share FROM t""",
        "argmax_fallback": with_
        + PROBS
        + """ SELECT vec_id, round(confidence, 9) AS confidence,
          CASE WHEN confidence < 0.02 THEN 'Diğer' ELSE prediction END AS prediction FROM best""",
        "confidence_band": with_
        + PROBS
        + """ SELECT vec_id, CASE WHEN confidence * 30 < 0.5 THEN 'low' WHEN confidence * 30 < 0.7 THEN 'medium'
          ELSE 'high' END AS band FROM best""",
        "html_strip": r"""SELECT page_id, CASE WHEN regexp_matches(lower(html), '<(html|body|div)') THEN
            trim(regexp_replace(regexp_replace(html, '<[^<]+?>', '', 'g'), '\s+', ' ', 'g')) ELSE html END AS body FROM pages""",
        "decode_subjects": "SELECT doc_id AS mail_id, "
        + _TRIMMED.format("split_part(text, chr(10), 1)")
        + " AS subject FROM documents",
        "decode_bodies": "SELECT doc_id AS mail_id, " + _DECODED + " AS body FROM documents",
        "envelope_files": "SELECT doc_id AS mail_id, "
        + _TRIMMED.format("split_part(text, chr(10), 1)")
        + " AS subject, "
        + _DECODED
        + " AS body FROM documents",
        "default_fill": with_
        + MAILS
        + """, blanked AS (SELECT mail_id, CASE WHEN mail_id % 3 = 0 THEN '' ELSE subject END AS subject,
            coalesce(body, '') AS body FROM mails)
          SELECT mail_id, CASE WHEN subject = '' THEN 'Test' ELSE subject END AS subject,
            CASE WHEN body = '' THEN subject ELSE body END AS body FROM blanked WHERE subject <> '' OR body <> ''""",
        "block_records": with_
        + BLOCK_TEXT
        + """, heads AS (SELECT response_id, category, rec, max(v) FILTER (kind = 'subject') AS subject,
            min(part) FILTER (kind = 'body' AND v IS NOT NULL) AS part FROM seg GROUP BY ALL),
          bodies AS (SELECT s.response_id, s.rec, string_agg(CASE WHEN kind = 'body' THEN v ELSE l END, ' ' ORDER BY pos) AS body
            FROM seg s JOIN heads h ON h.response_id = s.response_id AND h.rec = s.rec AND h.part = s.part
            WHERE kind IN ('body', 'text') GROUP BY ALL)
          SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY rec) AS record, category, subject, body
          FROM heads JOIN bodies USING (response_id, rec) WHERE subject IS NOT NULL""",
        "train_report_nb": with_
        + bayes_sql(MAILS)
        + """,
pairs AS (
  SELECT t.category AS truth, p.category AS prediction, count(*) AS n
  FROM parts t JOIN picked p ON p.mail_id = t.mail_id AND r = 1 WHERE split = 'test' GROUP BY ALL)"""
        + _class_scores("pairs", "cls")
        + REPORT,
        "svm_certificate": with_
        + CLEAN
        + SPLIT
        + """,
folded AS (
  SELECT mail_id, k.category, CASE WHEN r <= t // 3 + (t % 3 > 0)::INT THEN 0
    WHEN r <= 2 * (t // 3) + (t % 3 > 0)::INT + (t % 3 > 1)::INT THEN 1 ELSE 2 END AS own
  FROM keyed k JOIN (SELECT category, train::BIGINT AS t FROM shares) s USING (category) WHERE r <= t)
SELECT fold::INT AS fold, c.category, count(*) AS rows, count(*) FILTER (folded.category = c.category) AS positives, true AS optimal
FROM (SELECT unnest([0, 1, 2]) AS fold), (SELECT DISTINCT category FROM folded) c, folded WHERE own <> fold GROUP BY ALL""",
        "score_mails": with_
        + bayes_sql(MAILS)
        + """ SELECT mail_id, CASE WHEN max(p) < 0.6 THEN 'Diğer' ELSE max(category) FILTER (r = 1) END AS prediction,
          round(max(p), 5) AS confidence,
          CASE WHEN max(p) < 0.5 THEN 'low' WHEN max(p) < 0.7 THEN 'medium' ELSE 'high' END AS band,
          string_agg(category, ' ' ORDER BY r) FILTER (r <= 3) AS top_labels FROM picked GROUP BY mail_id""",
        "stream_score": with_
        + bayes_sql(MESSAGES)
        + """ SELECT f.mail_id, any_value(subject) AS subject, substr(any_value(body), 1, 500) AS body,
          max(category) FILTER (r = 1) AS prediction,
          string_agg(category || ':' || round(p, 4)::DECIMAL(5, 4)::VARCHAR, ' ' ORDER BY category) AS probabilities
          FROM filled f JOIN picked p ON p.mail_id = f.mail_id + 1000000000000 GROUP BY f.mail_id""",
        "export_clean_set": with_
        + CLEAN
        + """ SELECT category, count(*) AS n, sum(length(text_raw))::BIGINT AS raw_chars,
          sum(length(text_clean))::BIGINT AS clean_chars, sum("""
        + _CRC32.format("text_clean")
        + ")::BIGINT AS clean_crc32 FROM clean GROUP BY category",
        "evaluation_tables": with_
        + SCORES
        + DENSE
        + " SELECT truth, prediction, n, round(f1, 9) AS f1 FROM dense JOIN cls ON cls.label = truth",
        "export_tfidf": with_
        + CLEAN
        + DUAL_VOCAB
        + WEIGHTS
        + """ SELECT kind || ':' || term AS feature, count(*) AS mails, round(sum(weight), 4) AS weight
          FROM weights JOIN vocab USING (kind, feature_index) GROUP BY ALL""",
        "stream_dedupe": "SELECT event_id, user_id, event_type, value FROM events",
        "store_append": with_
        + MAILS
        + """ SELECT category, count(*) AS n FROM (SELECT category FROM mails
          QUALIFY row_number() OVER (PARTITION BY subject, body ORDER BY mail_id) = 1) GROUP BY category""",
        "csv_round_trip": with_
        + MAILS
        + """ SELECT mail_id::VARCHAR AS mail_id, category, subject, body FROM mails
           WHERE category IS NOT NULL AND subject IS NOT NULL AND body IS NOT NULL""",
    }
    return sql
