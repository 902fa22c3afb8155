"""HTML pages, XML templates and XSD schemas; the documents are written from the test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableloom.functions.fieldmap import field_type_for, generator_for
from tableloom.plans.generate import Run, flat_dataset
from tableloom.plans.message import message_template
from tableloom.plans.spec import dataset_specs_from_json
from tableloom.registry.generation import AS_OF, SEED
from tableloom.registry.sql import draws, load, pick, text
from tableloom.session import new_work_path
from tableloom.sources import builtin, html, templates, xsd

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- HTML ----------------------------------------------------------------------------------

_STRIPPED = "trim(replace(replace(replace(replace(replace(replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))"
_LINKS = f"""SELECT page_id, i, {_STRIPPED} AS name, regexp_extract(a, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1) AS href
    FROM (SELECT page_id, unnest(x) AS a, unnest(range(len(x))) AS i
      FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a\\s*>') AS x FROM pages))"""


@query(
    f"SELECT name, arg_min(href, (page_id, i)) AS href FROM ({_LINKS}) WHERE name <> '' AND contains(href, '/') GROUP BY name"
)
def html_anchors(spark, sf) -> DataFrame:
    return html.anchors(load(spark, sf, "pages"), "page_id", "html", "/")


@query(
    f"""SELECT * FROM (SELECT name, arg_min(href, (page_id, i)) AS href,
      regexp_extract(arg_min(href, (page_id, i)), '^/([a-z]+)$', 1) AS id
      FROM ({_LINKS}) WHERE name <> '' AND contains(href, 'a') GROUP BY name) WHERE id <> ''"""
)
def html_anchor_ids(spark, sf):
    return html.anchors(load(spark, sf, "pages"), "page_id", "html", "a", r"^/([a-z]+)$")


def _listing_pages(spark, sf, edition: str) -> DataFrame:
    """A listing page per part: a good row, and one that is too short or badly named for some."""
    part = load(spark, sf, "part")
    key, lpad = F.col("p_partkey"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    stem = F.when(key % 5 == 0, F.upper("p_type")).otherwise(F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")))
    message = F.concat(stem, F.lit("."), lpad(F.col("p_size"), 3), F.lit("."), lpad(key % 1000, 3), F.lit(".01"))
    cell = lambda c: F.concat(F.lit("<td class='c'>"), c, F.lit("</td>"))
    link = F.concat(F.lit('<a href="/message/'), key.cast("string"), F.lit('/download">XSD</a>'))
    third = F.when(key % 7 == 0, F.lit("")).otherwise(cell(F.concat(F.lit(" <b>Org &amp; "), "p_brand", F.lit("</b> "))))
    page = F.concat(
        F.lit('<div class="business-area"><a href="#">'), "p_brand", F.lit("</a></div><table><TR><th>Id</th></TR>\n<tr>"),
        cell(message), cell(F.concat("p_name", F.lit(f" {edition}"))), third,
        F.when(key % 2 == 0, cell(link)).otherwise(cell(F.lit("none"))), F.lit("</tr></table>"),
    )
    return part.select(key.alias("page_id"), page.alias("html"))


_ROWS = """SELECT p_partkey AS page_id, 1 AS position, stem || '.' || lpad(p_size::VARCHAR, 3, '0') || '.'
      || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.01' AS message_id, p_name || ' {edition}' AS message_name,
      CASE WHEN p_partkey % 7 <> 0 THEN 'Org & ' || p_brand WHEN p_partkey % 2 = 0 THEN 'XSD' ELSE 'none' END AS submitting_org,
      p_brand AS business_area,
      CASE WHEN p_partkey % 2 = 0 THEN '/message/' || p_partkey || '/download' END AS xsd_url
    FROM (SELECT *, lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS stem FROM part)
    WHERE p_partkey % 5 <> 0"""


@query(_ROWS.format(edition="A"))
def html_rows(spark, sf):
    return html.listing_rows(_listing_pages(spark, sf, "A"), "page_id", "html")


@query(
    f"""SELECT message_id, message_name, arg_min(xsd_url IS NULL, (page_id, position)) AS no_link, min(page_id) AS page_id
    FROM ({_ROWS.format(edition='A')} UNION ALL {_ROWS.format(edition='A')} UNION ALL {_ROWS.format(edition='B')})
    GROUP BY message_id, message_name"""
)
def messages_union(spark, sf):
    """Listing pages read twice, and once in another edition: every (id, name) once."""
    first = html.listing_rows(_listing_pages(spark, sf, "A"), "page_id", "html")
    other = html.listing_rows(_listing_pages(spark, sf, "B"), "page_id", "html")
    every = html.all_messages(first, first, other)
    return every.select("message_id", "message_name", F.col("xsd_url").isNull().alias("no_link"), "page_id")


def _loose_pages(spark, sf) -> DataFrame:
    """Pages as they are found: sections or tables, end tags left out, bare attributes, entities and comments."""
    part = load(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    link = lambda tag: F.concat(F.lit("<a class=x href=&#47;message/"), key, F.lit(f"&#x2F;download>{tag}</a>"))
    message = F.concat(F.lit("pacs."), F.lpad("p_size", 3, "0"), F.lit(".001.02"))
    table = F.concat(
        F.lit("<!-- <tr><td>camt.001.001.01<td>no<td>no --><table><tr><th>Id<tr><td>"), message,
        F.lit("<td>Caf&eacute; &#8364; &unknown; &lt;"), key, F.lit("&gt;<td><i>Org&nbsp;&amp; Co</i>"), link("get"), F.lit("</table>"),
    )
    sections = F.concat(
        F.lit('<details><summary>S</summary><div class="views-row odd"><span class="views-field a"> '), message,
        F.lit("</span> <span class='views-field'>"), "p_name", F.lit('</span><span class="views-field">'), "p_brand", F.lit("</span></div>"),
        F.lit('<div class="views-row"><span class="views-field">short</span></div></details><script>var a = "<a href=/message/1/download>x</a>"</script>'),
    )
    return part.select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 2 == 0, table).otherwise(sections).alias("html"))


_LOOSE = """SELECT p_partkey AS page_id, 'pacs.' || lpad(p_size::VARCHAR, 3, '0') || '.001.02' AS message_id,
    CASE WHEN p_partkey % 2 = 0 THEN 'Café € &unknown; <' || p_partkey || '>' ELSE p_name END AS message_name,
    CASE WHEN p_partkey % 2 = 0 THEN 'Org & Coget' ELSE p_brand END AS submitting_org,
    CASE WHEN p_partkey % 2 = 0 THEN '/message/' || p_partkey || '/download' END AS xsd_url FROM part"""


@query(_LOOSE)
def html_loose_rows(spark, sf):
    return html.listing_rows(_loose_pages(spark, sf), "page_id", "html").drop("position", "business_area")


@query("SELECT 'get' AS name, '/message/' || min(p_partkey) || '/download' AS href FROM part WHERE p_partkey % 2 = 0")
def html_loose_anchors(spark, sf):
    """Comments and scripts hold no link; the first of equal names wins."""
    return html.anchors(_loose_pages(spark, sf), "page_id", "html", "/message/")


def _nested_pages(spark, sf) -> DataFrame:
    """Tables inside cells: the outer row is a message itself, holds the inner cells, and its link stands below them."""
    part = load(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    message = lambda area, c: F.concat(F.lit(f"{area}."), F.lpad(c, 3, "0"), F.lit(".001.02"))
    inner = F.concat(
        F.lit("<table><tr><td>"), message("camt", F.col("p_size").cast("string")), F.lit("<td>inner "), key,
        F.lit("</td><td><div>Org <span>I</span></div></td></tr><tr><td>too<td>short</table>"),
    )
    link = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<p><a href='/message/"), key, F.lit("/download'>x</a>")))
    page = F.concat(
        F.lit("<div class=\"x business-area\"><p>Area: <a href='#'>"), "p_brand", F.lit("</a></div><table><tbody><tr><td>"),
        message("pacs", F.col("p_size").cast("string")), F.lit("<td>"), "p_name", F.lit("<td>see"), inner, link, F.lit("</td></tr></table>"),
    )
    return part.select(F.col("p_partkey").alias("page_id"), page.alias("html"))


@query(
    """SELECT p_partkey AS page_id, position, area || '.' || lpad(p_size::VARCHAR, 3, '0') || '.001.02' AS message_id,
      CASE WHEN position = 0 THEN p_name ELSE 'inner ' || p_partkey END AS message_name,
      CASE WHEN position = 0 THEN 'seecamt.' || lpad(p_size::VARCHAR, 3, '0') || '.001.02inner ' || p_partkey || 'Org Itooshort' || CASE
        WHEN p_partkey % 3 = 0 THEN '' ELSE 'x' END ELSE 'Org I' END AS submitting_org, p_brand AS business_area,
      CASE WHEN position = 0 AND p_partkey % 3 <> 0 THEN '/message/' || p_partkey || '/download' END AS xsd_url
    FROM part, (VALUES (0, 'pacs'), (1, 'camt')) r(position, area)"""
)
def html_nested_rows(spark, sf):
    """Rows and cells follow the tree, also through tables inside cells."""
    return html.listing_rows(_nested_pages(spark, sf), "page_id", "html")


_DOMAINS = "(VALUES " + ", ".join(f"({text(i)}, {text(n)})" for i, n in builtin.DOMAINS) + ") d(id, name)"
_MESSAGES = "(VALUES " + ", ".join(f"({text(i)}, {text(a)})" for i, _, a in builtin.MESSAGES) + ") m(message_id, area)"


@query(
    f"""WITH n AS (SELECT area, message_id, row_number() OVER (ORDER BY message_id) - 1 AS place
      FROM {_MESSAGES} WHERE area IN (SELECT name FROM {_DOMAINS}))
    SELECT area, message_id, count(*) AS uses FROM orders JOIN n ON o_custkey % 12 = place GROUP BY area, message_id"""
)
def builtin_messages(spark, sf):
    """The built-in messages of known domains, with the number of orders assigned to each."""
    known = F.col("business_area") == F.col("name")
    listed = builtin.messages(spark).join(builtin.domains(spark), known, "left_semi")
    numbered = listed.select(
        F.col("business_area").alias("area"),
        "message_id",
        (F.row_number().over(Window.orderBy("message_id")) - 1).alias("place"),
    )  # twelve rows
    uses = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 12).alias("place")).agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(numbered, "place").select("area", "message_id", "uses")


# --- templates -----------------------------------------------------------------------------

FILE_TEMPLATES = 50_000  # in a file: one task reads a whole XML file


def _dealt(spark, sf, table: str, key: str) -> DataFrame:
    """The rows dealt to tasks evenly: they are short and lie in few row groups, what is made of them is long."""
    return load(spark, sf, table).repartition(key)


def _template_files(spark, sf) -> DataFrame:
    """An XML template per part, written and read back as files of bounded size."""
    size = F.col("p_size").cast("string")
    body = F.concat(
        F.lit('<template name="T'), F.col("p_partkey").cast("string"), F.lit('" category="'), "p_brand", F.lit('">'),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<meta description="'), "p_name", F.lit('" version="2.0"/>'))).otherwise(""),
        F.lit('<field name="id" type="integer" generator="uuid_int" unique="TRUE"/>'),
        F.lit('<field name="note"/>'),
        F.lit('<field name="size" type="integer" generator="random_int" null_probability="0.5"><constraint min="1" max="'),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("lots")).otherwise(size),
        F.lit('" min_age="1.5" right_digits="2"/></field>'),
        F.lit('<field name="kind" generator="random_element" if="size &gt; 3"><constraint values="&lt;1M,'),
        "p_name", F.lit('" weights="1,2"/></field>'),
        F.lit('<field name="label" generator="formula" formula="{{ kind|lower }}-{{ size }}"/>'),
        F.lit('<relationship type="ref" source="id" target="other.id"/></template>'),
    )
    path = new_work_path(spark, "templates")
    made = _dealt(spark, sf, "part", "p_partkey").select(body.alias("value"))
    made.write.option("maxRecordsPerFile", FILE_TEMPLATES).text(path)
    return templates.read_templates(spark, path)


_HAS_MAX = "CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END"


@query(
    f"""SELECT 'T' || p_partkey AS template, position, name, type, generator, uniq AS unique, formula, null_probability, condition,
      min, max, min_age, "values", weights, right_digits FROM part, LATERAL (VALUES
      (0, 'id', 'integer', 'uuid_int', true, NULL, NULL, NULL, NULL, NULL, NULL::INTEGER, NULL, NULL, NULL),
      (1, 'note', 'string', 'text', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
      (2, 'size', 'integer', 'random_int', false, NULL, 0.5::DOUBLE, NULL, 1::DOUBLE, {_HAS_MAX}, NULL, NULL, NULL, 2),
      (3, 'kind', 'string', 'random_element', false, NULL, NULL, 'size > 3', NULL, NULL, NULL, '<1M,' || p_name, '1,2', NULL),
      (4, 'label', 'string', 'formula', false, '{{{{ kind|lower }}}}-{{{{ size }}}}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
    ) f(position, name, type, generator, uniq, formula, null_probability, condition, min, max, min_age, "values", weights, right_digits)"""
)
def xml_template_fields(spark, sf):
    return templates.template_fields(_template_files(spark, sf)).drop("max_age", "format", "start", "end")


@query(
    """SELECT 'T' || p_partkey AS name, p_brand AS category, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS description,
      CASE WHEN p_partkey % 2 = 0 THEN '2.0' ELSE '1.0' END AS version, 5::BIGINT AS field_count FROM part"""
)
def xml_template_listing(spark, sf):
    return templates.list_templates(_template_files(spark, sf))


_RUN = Run(SEED, homogeneity=100, as_of=AS_OF)


def template_dataset(spark, sf):
    """A template read from files, applied to one row per order."""
    spec = templates.get_template(_template_files(spark, sf), "T4").datasets("made", 1)[0]
    return flat_dataset(spark, spec, _RUN, row_ids=load(spark, sf, "orders").select("o_orderkey"), keep_row_id=True).select(
        "row_id", "size", "kind", "label"
    )


_MADE = draws(
    "SELECT o_orderkey AS row_id FROM orders", ["row_id"],
    {"size": (SEED, "size", 0), "roll": (SEED, "size", "null"), "kind": (SEED, "kind", 0)},
)
QUERIES["template_dataset"] = template_dataset


@query(
    f"""WITH n AS (SELECT max(p_size) AS top FROM part)
    SELECT row_id, (size % top + 1)::BIGINT AS size FROM ({draws("SELECT o_orderkey AS row_id FROM orders", ["row_id"], {"size": (SEED, "size", 0)})}), n"""
)
def json_dataset(spark, sf):
    """A dataset described as JSON, with bounds from one table and a row per key of another."""
    top = load(spark, sf, "part").agg(F.max("p_size")).first()[0]
    described = {"name": "sizes", "fields": [{"name": "size", "type": "integer", "generator": "random_int", "constraint": {"min": 1, "max": top}}]}
    (spec,) = dataset_specs_from_json(json.dumps(described))
    return flat_dataset(spark, spec, _RUN, row_ids=load(spark, sf, "orders").select("o_orderkey"), keep_row_id=True)


ORACLES["template_dataset"] = f"""WITH p AS (SELECT p_size, p_name FROM part WHERE p_partkey = 4),
    a AS (SELECT row_id, CASE WHEN roll >= {1 << 62} THEN size % p_size + 1 END AS size, kind, p_name FROM ({_MADE}), p),
    b AS (SELECT row_id, size, CASE WHEN size > 3 THEN CASE WHEN kind < {round((1 << 63) / 3)} THEN '<1M' ELSE p_name END END AS kind FROM a)
    SELECT *, coalesce(lower(kind), 'none') || '-' || coalesce(size::VARCHAR, 'None') AS label FROM b"""

# --- XSD -----------------------------------------------------------------------------------


def _schemas(spark, sf) -> DataFrame:
    """An XSD document per part, with names, enums and occurrence counts from its columns."""
    part = _dealt(spark, sf, "part", "p_partkey")
    size = F.col("p_size").cast("string")
    xsd_text = F.concat(
        F.lit('<?xml version="1.0"?>\n<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns="urn:test">'),
        F.lit('<xs:element name="Document" type="Document"/>'),
        F.lit('<xs:element name="Kind" type="KindCode" minOccurs="0" maxOccurs="'), size, F.lit('"><xs:annotation><xs:documentation> About  '),
        "p_name", F.lit('\n text </xs:documentation></xs:annotation></xs:element>'),
        F.lit('<xs:element name="Other" ref="Inline"/>'),
        F.lit('<xs:element name="Inline"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="'), size,
        F.lit('"/><xs:enumeration value=""/></xs:restriction></xs:simpleType></xs:element>'),
        F.lit('<xs:element name="Part"><xs:complexType><xs:sequence><xs:element name="due_date" type="xs:string"/>'),
        F.lit('<xs:element name="Total" type="xs:decimal" minOccurs="0"/><xs:choice><xs:element name="iban" type="t:Text"/></xs:choice></xs:sequence></xs:complexType></xs:element>'),
        F.lit('<xs:complexType name="Box"><xs:sequence><xs:element name="Total" type="xs:int"/><xs:element type="xs:date"/>'),
        F.lit('<xs:element name="Valid" type="xs:boolean"/></xs:sequence></xs:complexType>'),
        F.lit('<xs:simpleType name="KindCode"><xs:restriction base="xs:string"><xs:enumeration value="'), "p_brand",
        F.lit('"/><xs:enumeration value="'), "p_type", F.lit('"/></xs:restriction></xs:simpleType></xs:schema>'),
    )
    return part.select(F.col("p_partkey").alias("document"), xsd_text.alias("xsd"))


_FIELDS = """SELECT p_partkey AS document, f.* FROM part, LATERAL (VALUES
      (1, 'Kind', 'KindCode', 0, p_size::VARCHAR, 'About ' || p_name || ' text', p_brand || ',' || p_type, 'random_element', ''),
      (2, 'Other', 'Inline', 1, '1', NULL, p_size::VARCHAR, 'random_element', ''),
      (3, 'Inline', '', 1, '1', NULL, p_size::VARCHAR, 'random_element', ''),
      (4, 'Part', '', 1, '1', NULL, NULL, 'text', 'due_date,Total,iban'),
      (5, 'due_date', 'xs:string', 1, '1', NULL, NULL, 'date_between', ''),
      (6, 'Total', 'xs:decimal', 0, '1', NULL, NULL, 'pydecimal', ''),
      (7, 'iban', 't:Text', 1, '1', NULL, NULL, 'iban', ''),
      (10, 'Valid', 'xs:boolean', 1, '1', NULL, NULL, 'boolean', '')
    ) f(position, name, xsd_type, min_occurs, max_occurs, documentation, enums, mapped_generator, inside)"""


@query(_FIELDS.replace("f.* FROM", "'urn:test' AS namespace, f.* FROM"))
def xsd_fields(spark, sf):
    found = xsd.xsd_fields(_schemas(spark, sf)).withColumn("inside", F.array_join("nested.name", ","))
    return found.withColumn("enums", F.array_join("enumeration_values", ",")).drop("enumeration_values", "nested")


def _wide_schemas(spark, sf) -> DataFrame:
    """Per supplier: ``60 + s_nationkey`` elements in a row, 15 children of one, seven levels, a group and inner enums."""
    supplier = _dealt(spark, sf, "supplier", "s_suppkey")
    row = F.transform(
        F.sequence(F.lit(1), F.col("s_nationkey") + 60),
        lambda i: F.concat(F.lit('<xs:element name="e'), i.cast("string"), F.lit('" type="xs:int"/>')),
    )
    children = "".join(f'<xs:element name="c{i}" type="xs:date"/>' for i in range(15))
    levels = "".join(f'<xs:complexType><xs:sequence><xs:sequence><xs:element name="d{i}">' for i in range(1, 8))
    deep = f'<xs:element name="d0">{levels}' + "</xs:element></xs:sequence></xs:sequence></xs:complexType>" * 7 + "</xs:element>"
    enums = lambda part: F.concat(F.lit('<xs:restriction><xs:enumeration value="'), part, F.lit('"/></xs:restriction>'))
    text_ = F.concat(
        F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><!-- <xs:element name="no"/> -->'), F.array_join(row, ""),
        F.lit(f'<xs:element name="Wide"><xs:complexType><xs:sequence>{children}</xs:sequence></xs:complexType></xs:element>{deep}'),
        F.lit('<xs:group name="g"><xs:choice><xs:element name="in_group" type="xs:boolean"/></xs:choice></xs:group>'),
        F.lit('<xs:element name="Simple"><xs:complexType><xs:simpleContent>'), enums(F.lit("x")),
        F.lit('</xs:simpleContent><xs:attribute name="a"><xs:simpleType>'), enums(F.col("s_name")),
        F.lit("</xs:simpleType></xs:attribute></xs:complexType></xs:element></xs:schema>"),
    )
    return supplier.select(F.col("s_suppkey").alias("document"), text_.alias("xsd"))


_WIDE = """WITH n AS (SELECT s_suppkey AS document, s_nationkey + 60 AS n, s_name FROM supplier)
    SELECT document, (i - 1)::INT AS position, 'e' || i AS name, 'xs:int' AS xsd_type, 'random_int' AS mapped_generator,
      NULL::VARCHAR AS enums, '' AS inside FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS i)
    UNION ALL SELECT document, n::INT, 'Wide', '', 'text', NULL, 'c0,c1,c2,c3,c4,c5,c6,c7,c8,c9,c10,c11,c12,c13,c14' FROM n
    UNION ALL SELECT document, (n + 1 + i)::INT, 'c' || i, 'xs:date', 'date_between', NULL, '' FROM n, LATERAL (SELECT unnest(range(15)) AS i)
    UNION ALL SELECT document, (n + 16 + i)::INT, 'd' || i, '', 'text', NULL,
      coalesce((SELECT string_agg('d' || j, ',' ORDER BY j) FROM range(8) t(j) WHERE j > i), '') FROM n, LATERAL (SELECT unnest(range(8)) AS i)
    UNION ALL SELECT document, (n + 24)::INT, 'in_group', 'xs:boolean', 'boolean', NULL, '' FROM n
    UNION ALL SELECT document, (n + 25)::INT, 'Simple', '', 'random_element', 'x,' || s_name, '' FROM n"""


@query(_WIDE)
def xsd_wide_fields(spark, sf):
    """More than 50 elements, more than ten children, seven levels, a group, and enums in content and attributes."""
    found = xsd.xsd_fields(_wide_schemas(spark, sf)).withColumn("inside", F.array_join("nested.name", ","))
    found = found.withColumn("enums", F.array_join("enumeration_values", ","))
    return found.select("document", "position", "name", "xsd_type", "mapped_generator", "enums", "inside")


@query(
    """SELECT p_partkey AS document, f.* FROM part, LATERAL (VALUES ('Part', 0, 'due_date', 'xs:string', 1, 'date_between'),
      ('Part', 1, 'Total', 'xs:decimal', 0, 'pydecimal'), ('Part', 2, 'iban', 't:Text', 1, 'iban')
    ) f(parent, position, name, xsd_type, min_occurs, mapped_generator)"""
)
def xsd_nested_fields(spark, sf):
    return xsd.nested_fields(xsd.xsd_fields(_schemas(spark, sf))).drop("max_occurs")


@query(
    f"""SELECT document, position, -1 AS child, name, CASE WHEN regexp_matches(lower(xsd_type), 'decimal|amount|price|rate') THEN 'float'
      WHEN regexp_matches(lower(xsd_type), 'numeric|integer|year|index') THEN 'integer'
      WHEN regexp_matches(lower(xsd_type), 'date|time|timestamp') THEN 'date'
      WHEN regexp_matches(lower(xsd_type), 'boolean|indicator') THEN 'boolean' ELSE 'string' END AS type,
      mapped_generator AS generator, enums AS "values"
    FROM ({_FIELDS}) UNION ALL
    SELECT p_partkey, 4, f.* FROM part, LATERAL (VALUES (0, 'Part_due_date', 'string', 'date_between', NULL::VARCHAR),
      (1, 'Part_Total', 'float', 'pydecimal', NULL), (2, 'Part_iban', 'string', 'iban', NULL)) f(n, a, b, c, d)"""
)
def message_template_rows(spark, sf):
    return xsd.template_rows(xsd.xsd_fields(_schemas(spark, sf)))


@query(
    f"""WITH one AS (SELECT * FROM ({_FIELDS}) WHERE document = (SELECT max(p_partkey) FROM part))
    SELECT name, mapped_generator AS generator, coalesce(enums, '') AS choices FROM one
    UNION ALL VALUES ('Part_due_date', 'date_between', ''), ('Part_Total', 'pydecimal', ''), ('Part_iban', 'iban', '')"""
)
def message_template_fields(spark, sf):
    """The template of one message of many, field by field."""
    last = load(spark, sf, "part").agg(F.max("p_partkey")).first()[0]
    one = _schemas(spark, sf).where(F.col("document") == last)  # before it is parsed: no filter passes the parser
    template = message_template(xsd.xsd_fields(one), "message")
    rows = [(f.name, f.generator, f.constraint.values or "") for f in template.fields]
    return spark.createDataFrame(rows, "name string, generator string, choices string")


# --- field mapping -------------------------------------------------------------------------

# Fixed values, written a second time so that the rules themselves are compared.
_TYPE_RULES = [
    ("decimal", "pydecimal"),
    ("int", "random_int"),
    ("date", "date_between"),
    ("boolean", "boolean"),
    ("time", "date_time"),
]
_NAME_RULES = [
    ((
        "amount|value|price|total|sum|limit|fee|tax|charge|rate|interest|payment_amount|sttlm_amt|"
        "instd_amt|reqd_advd_amt|ccy_amt"
    ), "pydecimal"),
    ("currency|ccy", "currency_code"),
    ("bic|swift", "swift"),
    ("iban", "iban"),
    ("bban", "bban"),
    ("email|electronic_mail", "email"),
    ("phone|telephone|contact|mobile|fax", "phone_number"),
    ("country|ctry|nation|cntry", "country_code"),
    ("city|town|municipality", "city"),
    ("postal_code|zip|post_code|pstl_cd", "zipcode"),
    ("address|street|adr|line|pstl_adr", "street_address"),
    ("name|nm|full_name|surname|last_name|first_name|gvn_nm|faml_nm|middl_nm", "name"),
    ("date|dt|timestamp|datetime|cre_dt|due_date|reqd_exctn_dt|intnd_to_dt", "date_between"),
    ("uri|url|link|website|web", "url"),
    ("description|desc|purpose|purp|note|rmk|instr|addtl_inf", "text"),
    ("id|identifier|ref|reference|acct_id|tx_id|msg_id|msg_rcpt|end_to_end_id|uetr|clr_sys_ref", "bothify"),
    ("account|acct|acct_id", "bban"),
    ("bank|financial_institution|instg_agt|instd_agt|agt", "company"),
    ("status|stat|sts", "random_element"),
    ("type|tp|kind|categ|ctgy", "random_element"),
    ("code|cd", "bothify"),
    ("percent|pctg|pct", "pydecimal"),
    ("quantity|qty|count|nb|number|nmbr|total_qty", "random_int"),
    ("boolean|flag|indicator|ind|active|enabled|yes_no|authntcn_ind", "boolean"),
    ("credit|debit|cdt|dbt|charge", "random_element"),
    ("exchange|xchg_rate|rate|fx_rate", "pydecimal"),
    ("sequence|seq|order|ordr", "random_int"),
    ("version|vrsn", "random_int"),
]
_KEYWORDS = sorted({w for words, _ in _NAME_RULES for w in words.split("|")})
_TYPES = ["", "xs:string", "DecimalNumber", "xs:int", "ISODate", "YesNoIndicator", "xs:boolean", "ISOTime", "ISODateTime", "{urn}Max15NumericText", "AmountRate", "xs:integer"]


def _rule_sql(name: str, kind: str, edge: str) -> str:
    """The mapping as CASE; ``edge`` is a pattern pair for the border of a word."""
    before, after = edge.split("@")
    rules = [f"WHEN contains({kind}, {text(part)}) THEN {text(made)}" for part, made in _TYPE_RULES]
    rules += [
        f"WHEN regexp_matches({name}, {text('(?i)' + before + '(' + words + ')' + after)}) THEN {text(made)}"
        for words, made in _NAME_RULES
    ]
    return f"CASE {' '.join(rules)} ELSE 'text' END"


def _named_parts(spark, sf):
    at = lambda values: F.element_at(F.lit(values), (F.col("p_partkey") % len(values) + 1).cast("int"))
    return load(spark, sf, "part").select(
        F.concat("p_name", at([" ", "_", "-"]), F.upper(F.substring(at(_KEYWORDS), 1, 1)), F.substring(at(_KEYWORDS), 2, 99)).alias("name"),
        F.element_at(F.lit(_TYPES), (F.col("p_size") % len(_TYPES) + 1).cast("int")).alias("xsd_type"),
        "p_partkey",
    )


_NAMED = f"""SELECT p_name || {pick([' ', '_', '-'], 'p_partkey')} || upper(left({pick(_KEYWORDS, 'p_partkey')}, 1))
    || substr({pick(_KEYWORDS, 'p_partkey')}, 2) AS name, {pick(_TYPES, 'p_size')} AS xsd_type, p_partkey FROM part"""
_KIND = "lower(split_part(xsd_type, '}', -1))"


def _type_sql(rules: tuple) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({_KIND}, {text(p)}) THEN {text(t)}" for p, t in rules) + " ELSE 'string' END"


@query(
    f"""SELECT p_partkey, name, {_rule_sql('name', _KIND, chr(92) + 'b@' + chr(92) + 'b')} AS generator,
      {_type_sql((('decimal', 'float'), ('int', 'integer'), ('boolean', 'boolean'), ('time', 'datetime'), ('date', 'date')))} AS strict_type,
      {_type_sql((('decimal|amount|price|rate', 'float'), ('numeric|integer|year|index', 'integer'), ('date|time|timestamp', 'date'), ('boolean|indicator', 'boolean')))} AS broad_type
    FROM ({_NAMED})"""
)
def field_map(spark, sf):
    return _named_parts(spark, sf).select(
        "p_partkey", "name",
        generator_for(F.col("name"), F.col("xsd_type"), F.lit(False)).alias("generator"),
        field_type_for(F.col("xsd_type"), "strict").alias("strict_type"),
        field_type_for(F.col("xsd_type"), "broad").alias("broad_type"),
    )


@query(
    f"""SELECT name, {_rule_sql('name', "''", '(^|[^\\p{L}\\p{M}\\p{N}_])@($|[^\\p{L}\\p{M}\\p{N}_])')} AS generator
    FROM (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS name FROM documents) WHERE name <> ''"""
)
def field_map_words(spark, sf):
    """Every distinct token of the document texts taken as a field name."""
    words = load(spark, sf, "documents").select(F.explode_outer(F.split("text", r"(?U)[ \t\n\r\f]+")).alias("name")).where("name <> ''")
    return words.distinct().select("name", generator_for(F.col("name"), F.lit(""), F.lit(False)).alias("generator"))
