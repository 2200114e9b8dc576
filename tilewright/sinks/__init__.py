"""Writers: containers, archives, pictures, reports."""
