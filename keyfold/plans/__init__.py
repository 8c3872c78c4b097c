
"""Named query plans and plan shapes that Spark doesn't choose by itself."""
