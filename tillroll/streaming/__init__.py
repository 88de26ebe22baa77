from tillroll.streaming.ingest import start_ingest

__all__ = ["start_ingest"]
