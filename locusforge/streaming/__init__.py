from locusforge.streaming.studies import exit_status_stream, new_file_stream, status_state_stream

__all__ = ["exit_status_stream", "new_file_stream", "status_state_stream"]
