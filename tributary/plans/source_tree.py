"""Source files derived from the star-schema tables: one for each row, in three languages, and the SQL of what they declare.

Parts, customers and suppliers are Java types, suppliers, nations and regions
also Python modules in nested packages, and all but parts also JavaScript,
TypeScript or Vue files. So the tree grows with the tables, and DuckDB can tell
what a front end has to find in it from the rows alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.plans.demo import table

PORT = """package tpch.port;
public interface Supplier$kPort {
}
"""
CUSTOMER = """package tpch.party;
$import
@Component public class Customer$kController extends Base<Object> implements $up java.io.Serializable {
  enum Mode$k implements Runnable { ON, OFF }
}
"""
PART = """package tpch.catalog;
$import
import java.util.List;
/* import tpch.port.Supplier0Port; */
$bean public class Part$kUtil $up {
$field
$ctor
$line
}
"""
FIELD = "  @Autowired private Supplier$sPort port; // import tpch.port.Nothing;"
CTOR = '  public Part$kUtil(@Qualifier("a") final Supplier$sPort port, Map<String, Integer> m) { String t = "import tpch.port.Supplier0Port;"; }'
SUPPLIER_PY = """import os, sys
from region$r.nation$n import NAME  # from region0.nation0 import x
# import region.none
import numpy as np
from ..nation$n import KEY
from . import things
from .. import more
$prev
"""
SUPPLIER_JS = """import { a, b } from '../nations/nation$n'
import React from 'react';
import fs from 'fs';
import './style'
const x = require('./nothing')
$prev
"""
NATION_TS = """import type { R } from '../regions/region$r'
export * as gone from './gone$n';
"""
VUE = """<template/>
<SCRIPT setup lang="ts">
import * as s from '../suppliers/supplier$s'
</SCRIPT>
<script>import no from '../nations/nation0'</script>
"""
NO_VUE = "<template>import x from '../nations/nation0'</template>"


def filled(template: str, **columns: Column | str) -> Column:
    """The template with $name replaced by columns, as one column."""
    parts = re.split(r"\$(" + "|".join(columns) + ")", template)
    value = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(*[value(columns[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _file(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    return rows.select(path.alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def _union(*some: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, some)


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions (r), nations (n, r) and suppliers (k, n, r, and prev, before: the supplier one before and its region)."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")).join(nations, "n")
    earlier = suppliers.select((F.col("k") + 1).alias("k"), F.col("k").alias("prev"), F.col("r").alias("before"))
    return regions, nations, suppliers.join(earlier, "k", "left")


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces for suppliers, which some customers implement and parts want injected; parts extend the part before, but for every tenth."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k").withColumn("s", F.expr("k div 15"))
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k").withColumn("s", F.expr("k div 20"))
    some = F.expr("c_mktsegment = 'MACHINERY' and c_acctbal < 5000")
    when = lambda condition, text: F.when(condition, text).otherwise("")
    field, ctor = F.expr("p_size % 2 = 0"), F.expr("p_size % 3 = 0")
    port = filled("import tpch.port.Supplier$sPort;", s="s")
    risky = F.when(F.col("p_type") == "ECONOMY", '  Object o = Class.forName("x.Y");').when(F.col("p_type") == "PROMO", "  @EventListener void on(Object o) {}")
    risky = risky.when(F.col("p_type") == "STANDARD", "  Object m() { return method.invoke (o); }").otherwise("")
    part = filled(
        PART, k="k", bean=when(ctor, "@Service"), up=when(F.expr("k % 10 <> 0"), filled("extends Part$pUtil<String>", p=F.col("k") - 1)), line=risky,
        field=when(field, filled(FIELD, s="s")), ctor=when(ctor, filled(CTOR, k="k", s="s")), **{"import": when(field | ctor, port)},
    )
    customer = filled(CUSTOMER, k="k", up=when(some, filled("Supplier$sPort,", s="s")), **{"import": when(some, port)})
    root = "src/main/java/tpch"
    return _union(
        _file(suppliers, filled(f"{root}/port/Supplier$kPort.java", k="k"), filled(PORT, k="k")),
        _file(suppliers, filled("src/main/resources/Supplier$kMapper.xml", k="k"), F.lit("<mapper/>")),
        _file(customers, filled(f"{root}/party/Customer$kController.java", k="k"), customer),
        _file(parts, filled(f"{root}/catalog/Part$kUtil.java", k="k"), part),
    )


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package for each region with a module for each nation, and one below for its suppliers."""
    regions, nations, suppliers = _places(spark, sf_dir)
    prev = F.coalesce(filled("    import region$b.party.supplier$p as earlier, json", b="before", p="prev"), F.lit(""))
    return _union(
        _file(regions, filled("src/region$r/__init__.py", r="r"), F.lit("")),
        _file(regions, filled("src/region$r/party/__init__.py", r="r"), F.lit("from . import all_of_it\n")),
        _file(nations, filled("src/region$r/nation$n.py", r="r", n="n"), F.lit("import os, json\n")),
        _file(suppliers, filled("src/region$r/party/supplier$k.py", r="r", k="k"), filled(SUPPLIER_PY, r="r", n="n", prev=prev)),
    )


def javascript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes for regions, TypeScript for nations, JavaScript for suppliers, and Vue files for customers, some without a script."""
    regions, nations, suppliers = _places(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 15").alias("s"), "c_mktsegment")
    prev = F.coalesce(filled("export { x } from './supplier$p.js'", p="prev"), F.lit(""))
    script = F.when(F.col("c_mktsegment") == "HOUSEHOLD", NO_VUE).otherwise(filled(VUE, s="s"))
    return _union(
        _file(regions, filled("web/regions/region$r/index.ts", r="r"), F.lit("import path from 'node:path'\n")),
        _file(nations, filled("web/nations/nation$n.ts", n="n"), filled(NATION_TS, n="n", r="r")),
        _file(suppliers, filled("web/suppliers/supplier$k.js", k="k"), filled(SUPPLIER_JS, n="n", prev=prev)),
        _file(customers, filled("web/customers/Customer$k.vue", k="k"), script),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(java_files(spark, sf_dir), python_files(spark, sf_dir), javascript_files(spark, sf_dir))


# What the files declare, in DuckDB's SQL.

EXTENSIONS_SQL = """WITH s AS (SELECT count(*) AS n FROM supplier), c AS (SELECT count(*) AS n FROM customer), p AS (SELECT count(*) AS n FROM part),
 r AS (SELECT count(*) AS n FROM region), a AS (SELECT count(*) AS n FROM nation)
SELECT 'java' AS ext, s.n + c.n + p.n AS n FROM s, c, p UNION ALL SELECT 'xml', n FROM s UNION ALL SELECT 'py', 2 * r.n + a.n + s.n FROM r, a, s
UNION ALL SELECT 'ts', r.n + a.n FROM r, a UNION ALL SELECT 'js', n FROM s UNION ALL SELECT 'vue', n FROM c"""

_SUP = """sup AS (SELECT s_suppkey AS k, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 prev AS (SELECT b.k, b.r, a.k AS pk, a.r AS pr FROM sup b JOIN sup a ON a.k = b.k - 1)"""
_PATH = "'src/region' || r || '/party/supplier' || k || '.py'"
PY_IMPORTS_SQL = f"""WITH {_SUP}
SELECT {_PATH} AS path, unnest(['os', 'sys', 'numpy', '.', '..', 'region' || r || '.nation' || n, '..nation' || n]) AS import FROM sup
UNION ALL SELECT {_PATH}, unnest(['json', 'region' || pr || '.party.supplier' || pk]) FROM prev
UNION ALL SELECT 'src/region' || n_regionkey || '/nation' || n_nationkey || '.py', unnest(['os', 'json']) FROM nation
UNION ALL SELECT 'src/region' || r_regionkey || '/party/__init__.py', '.' FROM region"""
_ID = "'region' || r || '/party/supplier' || k"
PY_EDGES_SQL = f"""WITH {_SUP}
SELECT {_ID} AS source, 'region' || r || unnest(['/nation' || n, '/__init__', '/party/__init__']) AS target FROM sup
UNION ALL SELECT {_ID}, 'region' || pr || '/party/supplier' || pk FROM prev"""
JS_EDGES_SQL = f"""WITH {_SUP}
SELECT 'web/suppliers/supplier' || k || '.js' AS source, 'web/nations/nation' || n || '.ts' AS target FROM sup
UNION ALL SELECT 'web/suppliers/supplier' || k || '.js', 'web/suppliers/supplier' || pk || '.js' FROM prev
UNION ALL SELECT 'web/nations/nation' || n_nationkey || '.ts', 'web/regions/region' || r_regionkey || '/index.ts' FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'web/customers/Customer' || c_custkey || '.vue', 'web/suppliers/supplier' || k || '.js' FROM customer JOIN sup ON k = c_custkey // 15 WHERE c_mktsegment <> 'HOUSEHOLD'"""
VUE_SQL = "SELECT 'web/customers/Customer' || c_custkey || '.vue' AS path, c_mktsegment <> 'HOUSEHOLD' AS has_script FROM customer"
PACKAGES_SQL = "SELECT 'UnresolvedModule' AS type, 'web/suppliers/supplier' || s_suppkey || '.js' AS location, 'import of a package: react' AS description FROM supplier JOIN nation ON n_nationkey = s_nationkey"

_DI = """impl AS (SELECT s_suppkey AS s, 'tpch.party.Customer' || c_custkey || 'Controller' AS impl FROM customer JOIN supplier ON s_suppkey = c_custkey // 15 WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 5000),
 per AS (SELECT s, count(*) AS n, min(impl) AS impl FROM impl GROUP BY s),
 di AS (SELECT 'tpch.catalog.Part' || p_partkey || 'Util' AS source, 'tpch.port.Supplier' || s_suppkey || 'Port' AS wanted,
  CASE WHEN n IS NULL THEN 'tpch.port.Supplier' || s_suppkey || 'Port' WHEN n = 1 THEN impl END AS target, coalesce(n > 1, false) AS ambiguous
  FROM part JOIN supplier ON s_suppkey = p_partkey // 20 LEFT JOIN per ON s = s_suppkey WHERE p_size % 2 = 0 OR p_size % 3 = 0)"""
DI_SQL = f"WITH {_DI} SELECT source, wanted, target, ambiguous FROM di"
JAVA_EDGES_SQL = f"""WITH {_DI}
SELECT impl AS source, 'tpch.port.Supplier' || s || 'Port' AS target, 'IMPLEMENTS' AS type FROM impl
UNION ALL SELECT replace(replace(impl, 'Customer', 'Mode'), 'Controller', ''), 'tpch.port.Supplier' || s || 'Port', 'IMPORTS' FROM impl
UNION ALL SELECT source, target, 'SPRING_DI' FROM di WHERE target IS NOT NULL
UNION ALL SELECT source, wanted, 'IMPORTS' FROM di WHERE target IS NULL OR target <> wanted
UNION ALL SELECT 'tpch.catalog.Part' || a.p_partkey || 'Util', 'tpch.catalog.Part' || b.p_partkey || 'Util', 'EXTENDS' FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1 WHERE a.p_partkey % 10 <> 0"""
_FIELDS = """f AS (SELECT p_partkey AS k, 'port' AS field, 'Supplier' || p_partkey // 20 || 'Port' AS name, CASE WHEN s_suppkey IS NOT NULL THEN 'tpch.port.Supplier' || s_suppkey || 'Port' END AS target
  FROM part LEFT JOIN supplier ON s_suppkey = p_partkey // 20 WHERE p_size % 2 = 0
 UNION ALL SELECT p_partkey, 'o', 'Object', 'java.lang.Object' FROM part WHERE p_type = 'ECONOMY')"""
_PART = "'src/main/java/tpch/catalog/Part' || k || 'Util.java'"
FIELDS_SQL = f"""WITH {_FIELDS}
SELECT {_PART} AS path, 'tpch.catalog.Part' || k || 'Util' AS source, field, name, target, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM f"""
SOLVED_SQL = f"""WITH {_FIELDS}
SELECT {_PART} AS path, k NOT IN (SELECT k FROM f WHERE target IS NULL) AS solved FROM (SELECT p_partkey AS k FROM part)
UNION ALL SELECT 'src/main/java/tpch/party/Customer' || c_custkey || 'Controller.java', true FROM customer
UNION ALL SELECT 'src/main/java/tpch/port/Supplier' || s_suppkey || 'Port.java', true FROM supplier"""
IMPORTED_SQL = """SELECT 'src/main/java/tpch/' || place AS path, 'tpch.port.Supplier' || s_suppkey || 'Port' AS import, 'tpch.port.Supplier' || s_suppkey || 'Port' AS target FROM
 (SELECT 'catalog/Part' || p_partkey || 'Util.java' AS place, p_partkey // 20 AS s FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0
  UNION ALL SELECT 'party/Customer' || c_custkey || 'Controller.java', c_custkey // 15 FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 5000)
 JOIN supplier ON s_suppkey = s"""
BLIND_SQL = """SELECT CASE p_type WHEN 'PROMO' THEN 'event-driven' ELSE 'reflection' END AS type, 'src/main/java/tpch/catalog/Part' || p_partkey || 'Util.java:8' AS location,
 CASE p_type WHEN 'ECONOMY' THEN 'Class.forName' WHEN 'PROMO' THEN '@EventListener' ELSE 'Method.invoke' END AS description FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD')
UNION ALL SELECT 'mybatis-xml', 'src/main/resources/Supplier' || s_suppkey || 'Mapper.xml', 'MyBatis XML' FROM supplier"""
NODES_SQL = f"""WITH {_SUP}
SELECT 'tpch.port.Supplier' || s_suppkey || 'Port' AS id, 'INTERFACE' AS type, 'src/main/java/tpch/port/Supplier' || s_suppkey || 'Port.java' AS source_path FROM supplier
UNION ALL SELECT 'tpch.party.Customer' || c_custkey || 'Controller', 'CLASS', 'src/main/java/tpch/party/Customer' || c_custkey || 'Controller.java' FROM customer
UNION ALL SELECT 'tpch.party.Mode' || c_custkey, 'ENUM', 'src/main/java/tpch/party/Customer' || c_custkey || 'Controller.java' FROM customer
UNION ALL SELECT 'tpch.catalog.Part' || p_partkey || 'Util', 'CLASS', 'src/main/java/tpch/catalog/Part' || p_partkey || 'Util.java' FROM part
UNION ALL SELECT {_ID}, 'MODULE', {_PATH} FROM sup
UNION ALL SELECT 'region' || n_regionkey || '/nation' || n_nationkey, 'MODULE', 'src/region' || n_regionkey || '/nation' || n_nationkey || '.py' FROM nation
UNION ALL SELECT 'region' || r_regionkey || p, 'MODULE', 'src/region' || r_regionkey || p || '.py' FROM region, (VALUES ('/__init__'), ('/party/__init__')) t(p)
UNION ALL SELECT f, 'MODULE', f FROM (SELECT 'web/regions/region' || r_regionkey || '/index.ts' AS f FROM region UNION ALL SELECT 'web/nations/nation' || n_nationkey || '.ts' FROM nation
 UNION ALL SELECT 'web/suppliers/supplier' || k || '.js' FROM sup UNION ALL SELECT 'web/customers/Customer' || c_custkey || '.vue' FROM customer)"""
