"""Quillstone: evidence-grounded text-to-technique mapping and ranking evaluation on PySpark."""
