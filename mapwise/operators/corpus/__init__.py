"""Course fields from document lines.

Input lines are (doc_id, file_name, page_no, line_no, rel_top, text), pages numbered from 0. All windows and
groups are within one document, which is at most one row of the source; lines arrive partitioned by doc_id, so
the steps add sorts but no exchange.
"""
