"""A small project in three languages, and what its analysis finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.schema import FILES

_BEAN = "package shop.{p};\n{imports}\n{head} {{\n{body}\n}}\n"


def _java(p, head, body="", imports=()):
    return _BEAN.format(p=p, head=head, body=body, imports="\n".join(f"import {i};" for i in imports))


PROJECT = {
    "src/main/java/shop/api/OrderController.java": _java("api", "@RestController public class OrderController", "  @Autowired private OrderService orders;\n  @Autowired UserRepository users; // two of these\n  void go() { String s = \"import shop.none.Nothing;\"; }", ("shop.core.OrderService", "shop.data.UserRepository", "java.util.List", "shop.core.*")),
    "src/main/java/shop/core/OrderService.java": _java("core", "public interface OrderService"),
    "src/main/java/shop/core/OrderServiceImpl.java": _java("core", "@Service\npublic class OrderServiceImpl extends Base<String> implements OrderService, java.io.Serializable", "  private final Mailer mailer;\n  public OrderServiceImpl(Mailer mailer) { this.mailer = mailer; }", ("static shop.core.Mailer.send",)),
    "src/main/java/shop/core/Base.java": _java("core", "public abstract class Base<T extends Comparable<T>>", "  /* class Hidden extends Base {} */\n  enum Mode implements Runnable { ON, OFF }"),
    "src/main/java/shop/core/Mailer.java": _java("core", "@Component public class Mailer", '  @EventListener void on(Object o) throws Exception {\n    Class.forName("x.Y");\n    method.invoke (o);\n  }'),
    "src/main/java/shop/data/UserRepository.java": _java("data", "public interface UserRepository"),
    "src/main/java/shop/data/UserRepositoryImpl.java": _java("data", "@Repository public class UserRepositoryImpl implements UserRepository"),
    "src/main/java/shop/data/CachedUserRepository.java": _java("data", "@Repository public class CachedUserRepository implements UserRepository"),
    "src/main/java/shop/api/ReportService.java": _java("api", "@Service public class ReportService", "  @Autowired\n  public ReportService(@Qualifier(\"a\") final OrderService orders, Map<String, Integer> m) {}\n  public ReportService() {}", ("shop.core.OrderService",)),
    "Loose.java": "public record Loose(int a, shop.core.Base b) implements Comparable<Loose> {}\n",
    "src/main/resources/UserMapper.xml": "<mapper/>",
    "web/main.js": "import { a, b } from './lib/util'\nimport App from './App.vue';\nimport React from 'react';\nimport fs from 'fs';\nimport './style';\nconst x = require('./nothing');\n",
    "web/lib/util.ts": "export * as tools from '../kit';\nexport { one } from \"./gone\";\nimport type { T } from './types.ts'\n",
    "web/kit/index.ts": "import path from 'node:path'\n",
    "web/App.vue": "<template/>\n<SCRIPT setup lang=\"ts\">\nimport * as util from './lib/util'\n</SCRIPT>\n<script>import no from './no'</script>",
    "web/Empty.vue": "<template>import x from './App.vue'</template>",
    "src/pkg/__init__.py": "",
    "src/pkg/utils.py": "import os, sys\nfrom pkg.helper import x\n# import pkg.none\n",
    "src/pkg/helper.py": "import numpy as np\n",
    "src/pkg/sub/__init__.py": "from . import deep\n",
    "src/pkg/sub/deep.py": "from ..helper import x  # up\n    import pkg.utils as u, json\nfrom . import things\n",
    "main.py": "import src\nfrom pkg.utils import *\nimport cProfile\n",
    "package.json": "{}",
}

PY_IMPORTS = [
    ("src/pkg/utils.py", "os"), ("src/pkg/utils.py", "sys"), ("src/pkg/utils.py", "pkg.helper"), ("src/pkg/helper.py", "numpy"),
    ("src/pkg/sub/__init__.py", "."), ("src/pkg/sub/deep.py", "..helper"), ("src/pkg/sub/deep.py", "pkg.utils"), ("src/pkg/sub/deep.py", "json"),
    ("src/pkg/sub/deep.py", "."), ("main.py", "src"), ("main.py", "pkg.utils"), ("main.py", "cProfile"),
]
PY_EDGES = [("pkg/utils", "pkg/helper"), ("pkg/sub/deep", "pkg/helper"), ("pkg/sub/deep", "pkg/utils"), ("pkg/sub/deep", "pkg/sub/__init__"), ("main", "pkg/utils")]
JS_EDGES = [("web/main.js", "web/lib/util.ts"), ("web/main.js", "web/App.vue"), ("web/lib/util.ts", "web/kit/index.ts"), ("web/App.vue", "web/lib/util.ts")]
JAVA_EDGES = [
    ("shop.api.OrderController", "shop.core.OrderService", "IMPORTS"), ("shop.api.OrderController", "shop.core.OrderServiceImpl", "SPRING_DI"),
    ("shop.api.OrderController", "shop.data.UserRepository", "IMPORTS"), ("shop.core.OrderServiceImpl", "shop.core.Base", "EXTENDS"),
    ("shop.core.OrderServiceImpl", "shop.core.OrderService", "IMPLEMENTS"), ("shop.core.OrderServiceImpl", "shop.core.Mailer", "SPRING_DI"),
    ("shop.data.UserRepositoryImpl", "shop.data.UserRepository", "IMPLEMENTS"), ("shop.data.CachedUserRepository", "shop.data.UserRepository", "IMPLEMENTS"),
    ("shop.api.ReportService", "shop.core.OrderService", "IMPORTS"), ("shop.api.ReportService", "shop.core.OrderServiceImpl", "SPRING_DI"),
]
DI = [
    ("shop.api.OrderController", "shop.core.OrderService", "shop.core.OrderServiceImpl", False),
    ("shop.api.OrderController", "shop.data.UserRepository", None, True),
    ("shop.core.OrderServiceImpl", "shop.core.Mailer", "shop.core.Mailer", False),
    ("shop.api.ReportService", "shop.core.OrderService", "shop.core.OrderServiceImpl", False),
]
BLIND_SPOTS = [
    ("event-driven", "src/main/java/shop/core/Mailer.java:4", "@EventListener"),
    ("reflection", "src/main/java/shop/core/Mailer.java:5", "Class.forName"),
    ("reflection", "src/main/java/shop/core/Mailer.java:6", "Method.invoke"),
    ("mybatis-xml", "src/main/resources/UserMapper.xml", "MyBatis XML"),
]


def files(spark: SparkSession, *extensions: str) -> DataFrame:
    """The project's files, all or those with some extensions."""
    rows = [(p, c, len(c.encode())) for p, c in PROJECT.items() if not extensions or p.rpartition(".")[2] in extensions]
    return spark.createDataFrame(rows, FILES)
