"""abode: property-listing analytics on Spark.

Cleaning of scraped listing text, catalogue queries, district statistics,
favourites / deposits / moderation views, set-based workflow changes and a
polynomial ridge price model, all expressed as DataFrame jobs.
"""

from abode.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
