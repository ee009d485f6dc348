"""glossa: translation-evaluation data jobs as Spark DataFrame operators.

Submodules: ``sources`` (readers, sinks, response cache), ``functions``
(Column expressions), ``operators`` (DataFrame -> DataFrame steps), ``plans``
(views, registered queries, oracle SQL, end-to-end jobs), ``streaming``
(incremental scoring).
"""

__version__ = "0.1.0"

from glossa.session import build_session, scratch_path, shared_dir  # noqa: E402,F401
