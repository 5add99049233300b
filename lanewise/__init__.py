"""Analytics for event logs of Kanban-style boards, on Spark DataFrames."""
