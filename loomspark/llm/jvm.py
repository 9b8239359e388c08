"""Java sources of this package as functions of Spark: compiled in the driver by Janino, which Spark itself needs, and sent
to executors as a jar by Spark's own file server, like the package's Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

_loaded: dict[tuple[str, str], object] = {}


def classes(spark: SparkSession, source: str):
    """A class loader of the driver with the classes of ``source``, which executors have too. Once per application."""
    context, jvm = spark.sparkContext, spark._jvm
    key = context.applicationId, source
    if key not in _loaded:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(resources.files(__package__).joinpath(f"{source}.java").read_text())
        folder = tempfile.mkdtemp(prefix="loomspark-")  # the driver serves the file to executors for as long as it runs
        atexit.register(shutil.rmtree, folder, True)
        jar, code = os.path.join(folder, f"{source}.jar"), compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as z:
            for name in code:
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code[name]))
        context._jsc.addJar(jar)
        _loaded[key] = compiler.getClassLoader()
    return _loaded[key]


def function(spark: SparkSession, source: str, name: str, returns: DataType | str, column: str) -> Column:
    """The class ``name`` of ``source``, a function of one argument, over a column."""
    if isinstance(returns, str):
        returns = StructType.fromDDL(f"x {returns}")["x"].dataType
    own = classes(spark, source).loadClass(f"loomspark.{source}${name}").getDeclaredConstructors()[0]
    known = f"loomspark_{source}_{name}".lower()
    session = spark._jsparkSession
    session.udf().register(known, own.newInstance(spark.sparkContext._gateway.new_array(spark._jvm.Object, 0)), session.parseDataType(returns.json()))
    return F.call_function(known, column)
